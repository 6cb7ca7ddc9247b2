"""The named queries over the TPC-H-like tables and the same in DuckDB SQL.

Statistics are rounded on both sides where the order of additions may change the last digits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.operators import compare, health, modes, seeded
from tablewright.operators.rows import row_column
from tablewright.operators.summary import op, summarise
from tablewright.plans import language
from tablewright.sources.scratch import scratch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _grouped(table: str, key: str, name: str, fields: Sequence[str], digits: int | None, param: object = None, rid: str | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = op(name, *fields, param=param, alias="value")
        return _rounded(summarise(_table(spark, sf_dir, table), [made], [key], rid), digits)

    return query


#: operation: (table, key, fields, parameter, digits, order column, SQL of the value)
V, W = "l_extendedprice", "l_quantity"
_BY_FLAG = ("lineitem", "l_returnflag")
_BY_SEGMENT = ("customer", "c_mktsegment")
_G1 = "(skewness(c_acctbal) * (count(*) - 2) / sqrt(count(*)::double * (count(*) - 1)))"
_N = "count(*)::double"
_SES = f"sqrt(6 * {_N} * ({_N} - 1) / (({_N} - 2) * ({_N} + 1) * ({_N} + 3)))"
_SEK = f"(2 * {_SES} * sqrt(({_N} * {_N} - 1) / (({_N} - 3) * ({_N} + 5))))"
SUMMARIES: dict[str, tuple] = {
    "count": (*_BY_FLAG, [V], None, None, None, f"count({V})"),
    "sum": (*_BY_FLAG, [V], None, 2, None, f"sum({V})"),
    "mean": (*_BY_FLAG, [V], None, 4, None, f"avg({V})"),
    "min": (*_BY_FLAG, [V], None, None, None, f"min({V})"),
    "max": (*_BY_FLAG, [V], None, None, None, f"max({V})"),
    "range": (*_BY_FLAG, [V], None, 4, None, f"max({V}) - min({V})"),
    "absmin": (*_BY_SEGMENT, ["c_acctbal"], None, None, "c_custkey", "arg_min(c_acctbal, abs(c_acctbal))"),
    "absmax": (*_BY_SEGMENT, ["c_acctbal"], None, None, "c_custkey", "arg_max(c_acctbal, abs(c_acctbal))"),
    "ms": (*_BY_FLAG, [W], None, 4, None, f"avg({W} * {W})"),
    "rms": (*_BY_FLAG, [W], None, 6, None, f"sqrt(avg({W} * {W}))"),
    "geomean": (*_BY_FLAG, [W], None, 6, None, f"exp(avg(ln({W})))"),
    "harmmean": (*_BY_FLAG, [W], None, 6, None, f"count(*) / sum(1 / {W})"),
    "trimmean": (*_BY_FLAG, [W], "0.2", 6, None, f"list_avg(list_slice(list_sort(list({W})), floor(count(*) * 0.2)::bigint + 1, count(*) - floor(count(*) * 0.2)::bigint))"),
    "wmean": (*_BY_FLAG, [V, W], None, 4, None, f"sum({V} * {W}) / sum({W})"),
    "median": (*_BY_FLAG, [V], None, 4, None, f"quantile_cont({V}, 0.5)"),
    "q1": (*_BY_FLAG, [V], None, 4, None, f"quantile_cont({V}, 0.25)"),
    "q3": (*_BY_FLAG, [V], None, 4, None, f"quantile_cont({V}, 0.75)"),
    "iqr": (*_BY_FLAG, [V], None, 4, None, f"quantile_cont({V}, 0.75) - quantile_cont({V}, 0.25)"),
    "perc": (*_BY_FLAG, [V], "90", 4, None, f"quantile_cont({V}, 0.9)"),
    "pvar": (*_BY_FLAG, [W], None, 6, None, f"var_pop({W})"),
    "svar": (*_BY_FLAG, [W], None, 6, None, f"var_samp({W})"),
    "pstdev": (*_BY_FLAG, [W], None, 6, None, f"stddev_pop({W})"),
    "sstdev": (*_BY_FLAG, [W], None, 6, None, f"stddev_samp({W})"),
    "madraw": (*_BY_FLAG, [V], None, 4, None, f"mad({V})"),
    "mad": (*_BY_FLAG, [V], None, 4, None, f"1.4826::double * mad({V})"),
    "pskew": (*_BY_SEGMENT, ["c_acctbal"], None, 6, None, _G1),
    "sskew": (*_BY_SEGMENT, ["c_acctbal"], None, 6, None, "skewness(c_acctbal)"),
    "pkurt": (*_BY_SEGMENT, ["c_acctbal"], None, 6, None, "kurtosis_pop(c_acctbal)"),
    "skurt": (*_BY_SEGMENT, ["c_acctbal"], None, 6, None, "kurtosis(c_acctbal)"),
    "jarque": (*_BY_SEGMENT, ["c_acctbal"], None, 8, None, f"exp(-count(*) * (kurtosis_pop(c_acctbal) ** 2 / 4 + {_G1} ** 2) / 12)"),
    "dpo": (*_BY_SEGMENT, ["c_acctbal"], None, 8, None, f"exp(-((skewness(c_acctbal) / {_SES}) ** 2 + (kurtosis(c_acctbal) / {_SEK}) ** 2) / 2)"),
    "pcov": (*_BY_FLAG, [W, V], None, 2, None, f"covar_pop({W}, {V})"),
    "scov": (*_BY_FLAG, [W, V], None, 2, None, f"covar_samp({W}, {V})"),
    "ppearson": (*_BY_FLAG, [W, V], None, 8, None, f"corr({W}, {V})"),
    "spearson": (*_BY_FLAG, [W, V], None, 8, None, f"corr({W}, {V})"),
    "dotprod": (*_BY_FLAG, [W, V], None, 2, None, f"sum({W} * {V})"),
    "countunique": (*_BY_FLAG, [W], None, None, None, f"count(distinct {W})"),
    "unique": ("orders", "o_orderpriority", ["o_orderstatus"], None, None, "o_orderkey", "string_agg(distinct o_orderstatus, ',' order by o_orderstatus)"),
    "collapse": ("orders", "o_custkey", ["o_orderpriority"], None, None, "o_orderkey", "string_agg(o_orderpriority, ',' order by o_orderkey)"),
    "first": ("orders", "o_orderpriority", ["o_orderdate"], None, None, "o_orderkey", "strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m-%d %H:%M:%S')"),
    "last": ("orders", "o_orderpriority", ["o_orderdate"], None, None, "o_orderkey", "strftime(arg_max(o_orderdate, o_orderkey), '%Y-%m-%d %H:%M:%S')"),
}

#: name: (operation, parameter, table, id, field, SQL of the value, digits)
ROWS: dict[str, tuple] = {
    "cut": ("cut", None, "customer", "c_custkey", "c_name", "c_name", None),
    "round": ("round", None, "customer", "c_custkey", "c_acctbal", "round(c_acctbal) + 0.0::double", None),
    "floor": ("floor", None, "customer", "c_custkey", "c_acctbal", "floor(c_acctbal)", None),
    "ceil": ("ceil", None, "customer", "c_custkey", "c_acctbal", "ceil(c_acctbal)", None),
    "trunc": ("trunc", None, "customer", "c_custkey", "c_acctbal", "trunc(c_acctbal) + 0.0::double", None),
    "frac": ("frac", None, "customer", "c_custkey", "c_acctbal", "c_acctbal - trunc(c_acctbal)", 6),
    "bin": ("bin", "250", "customer", "c_custkey", "c_acctbal", "floor(c_acctbal / 250) * 250 + 0.0::double", None),
    "strbin": (
        "strbin", "13", "part", "p_partkey", "p_name",
        "(list_reduce([0::hugeint] || [ord(c)::hugeint for c in string_split(p_name, '')], lambda h, b: ((h * 512) % 18446744073709551616 + h // 36028797018963968 + b) % 18446744073709551616) % 13)::bigint", None,
    ),
    "getnum": ("getnum", None, "part", "p_partkey", "p_brand", "regexp_extract(p_brand, '[0-9.]+')::double", None),
    "getnum_hex": ("getnum", "h", "part", "p_partkey", "p_brand", "('0x' || regexp_extract(p_brand, '[0-9a-fA-F]+'))::bigint::double", None),
    "base64": ("base64", None, "customer", "c_custkey", "c_name", "to_base64(encode(c_name))", None),
    "md5": ("md5", None, "customer", "c_custkey", "c_name", "md5(c_name)", None),
    "sha1": ("sha1", None, "customer", "c_custkey", "c_name", "sha1(c_name)", None),
    "sha256": ("sha256", None, "customer", "c_custkey", "c_name", "sha256(c_name)", None),
    "sha224": ("sha224", None, "customer", "c_custkey", "c_name", None, None),
    "sha384": ("sha384", None, "customer", "c_custkey", "c_name", None, None),
    "sha512": ("sha512", None, "customer", "c_custkey", "c_name", None, None),
    "dirname": ("dirname", None, "pages", "page_id", "url", "regexp_replace(regexp_replace(url, '/+$', ''), '/+[^/]*$', '')", None),
    "basename": ("basename", None, "pages", "page_id", "url", "regexp_extract(url, '([^/]*)/*$', 1)", None),
    "extname": ("extname", None, "pages", "page_id", "url", "regexp_extract(regexp_extract(url, '([^/]*)/*$', 1), '^.+?\\.([0-9A-Za-z]+)$', 1)", None),
    "barename": ("barename", None, "pages", "page_id", "url", "regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '^(.+?)\\.[0-9A-Za-z]+$', '\\1')", None),
}


def _row_query(name: str, param: str | None, table: str, key: str, field: str, digits: int | None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table)
        return _rounded(df.select(key, row_column(df, name, field, param).alias("value")), digits)

    return query


def row_debase64(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.base64(F.col("c_name").cast("binary")).alias("coded"))
    return df.select("c_custkey", row_column(df, "debase64", "coded").alias("value"))


def grp_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [op("count", W, alias="n"), op("sum", W, alias="total"), op("mean", V, alias="average"), op("median", V, alias="middle")]
    return _rounded(summarise(_table(spark, sf_dir, "lineitem"), ops, ["l_returnflag"]), 4)


def grp_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [op("count", W, alias="n"), op("q1", V, alias="low"), op("median", V, alias="middle"), op("q3", V, alias="high"), op("iqr", V, alias="spread")]
    return _rounded(summarise(_table(spark, sf_dir, "lineitem"), ops, ["l_returnflag", "l_linestatus"]), 4)


def grp_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summarise(_table(spark, sf_dir, "lineitem"), [op("sum", V, alias="total"), op("mean", V, alias="average")]), 2)


def grp_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [op("count", "event_id", alias="n"), op("sum", "value", alias="total"), op("first", "event_id", alias="head")]
    return _rounded(summarise(_table(spark, sf_dir, "events"), ops, ["event_type"], "event_id", sort=False), 4)


def grp_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    df = _table(spark, sf_dir, "events").withColumn("kind", mixed)
    return summarise(df, [op("count", "event_id", alias="n"), op("unique", "kind", alias="spellings")], ["kind"], "event_id", ignore_case=True)


def grp_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return summarise(df, [op("max", "o_totalprice", alias="most")], ["o_orderpriority"], "o_orderkey", full=True)


def grp_high_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [op("count", "l_partkey", alias="n"), op("unique", "l_linenumber", alias="lines")]
    return summarise(_table(spark, sf_dir, "lineitem"), ops, ["l_orderkey"])


def _with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 7 == 0, "NA").when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", "event_type", value.alias("v"))


def narm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [op("count", "v", alias="n"), op("sum", "v", alias="total"), op("min", "v", alias="least"), op("max", "v", alias="most"), op("mean", "v", alias="average")]
    return _rounded(summarise(_with_missing(spark, sf_dir), ops, ["event_type"], "event_id", narm=True), 4)


def narm_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    x = F.when(F.col("event_id") % 5 == 0, "NA").otherwise(F.col("event_id").cast("string"))
    y = F.when(F.col("event_id") % 5 == 1, "NA").otherwise((F.col("event_id") * 2).cast("string"))
    df = events.select("event_id", x.alias("x"), y.alias("y"))
    return summarise(df, [op("dotprod", "x", "y", alias="value")], rid="event_id", narm=True)


def rand_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded.seeded_rand(_table(spark, sf_dir, "events"), [op("rand", "event_id", alias="chosen")], 7, "event_id", ["event_type"])


def tbl_rmdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.remove_duplicates(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id")


def tbl_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.check(_table(spark, sf_dir, "orders"))


def tbl_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.reverse(_table(spark, sf_dir, "nation"))


def tbl_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = modes.transpose(_table(spark, sf_dir, "nation").withColumn("rid", F.col("n_nationkey")), "rid")
    return wide.select(F.col("pos").cast("long").alias("pos"), F.array_join("fields", "|").alias("row"))


def tbl_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.noop(_table(spark, sf_dir, "region"))


def ct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders")
    return modes.crosstab(df, "o_orderpriority", "o_orderstatus", labels=["F", "O", "P"])


def ct_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem")
    return modes.crosstab(df, "l_returnflag", "l_linestatus", op("max", "l_linenumber", alias="cell"), labels=["F", "O", "X"])


def ct_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return modes.crosstab(df, "event_type", "side", op("count", "event_id", alias="cell"), "event_id", sort=False, labels=["even", "odd"])


def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.top(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", 25, "o_orderkey")


def bottom_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.top(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", 25, "o_orderkey", bottom=True)


def top_n_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return modes.top(df, "o_totalprice", 5, "o_orderkey", group=["o_orderpriority"])


def top_n_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return modes.top(df, "value", 1, "event_id", group=["event_type"], sort=False)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderdate")
    renamed = lambda old, new: F.when(F.col("o_orderpriority") == old, new).otherwise(F.col("o_orderpriority"))
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    return df.where(early).withColumn("o_orderpriority", renamed("5-LOW", "5-LAST")), df.where(~early).withColumn("o_orderpriority", renamed("1-URGENT", "0-NOW"))


def _compared(rank: int | None = None, by: str = "absolute", limit: int | None = None, keys: Sequence[str] = ("o_orderpriority",)) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = [op("count", "o_orderkey", alias="n"), op("max", "o_totalprice", alias="most")]
        return _rounded(compare.compare(*_halves(spark, sf_dir), made, keys, rank, by, limit), 4)

    return query


def _ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    mixed = F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 13 == 0, "NA").when(F.col("event_id") % 17 == 0, "oops").otherwise(F.col("value").cast("string"))
    fields = F.array(F.col("event_id").cast("string"), "event_type", mixed)
    return e.select("event_id", F.when(F.col("event_id") % 19 == 0, F.slice(fields, 1, 2)).otherwise(fields).alias("fields"))


def _inspected(spark: SparkSession, sf_dir: str, **declared: object) -> DataFrame:
    rows = _ragged(spark, sf_dir).select(F.col("event_id").alias("rid"), F.array_join("fields", "\t").alias("raw"), "fields")
    return health.table(spark, health.inspect(rows, **declared))


def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _inspected(spark, sf_dir).where("row_kind = 'field'")
    cells = [F.max(F.when(F.col("category") == health.COUNTERS[c], F.col("count"))).alias(c) for c in health.CLASSES]
    return counted.groupBy(F.col("field_index").alias("pos")).agg(*cells, F.max("expected").alias("inferred"))


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _inspected(spark, sf_dir, types={1: "integer", 3: "integer"}, presence={3: "required"}, examples=1).where("row_kind in ('finding', 'example')")
    first = F.max("record_index").alias("first_row")
    return found.groupBy("category", "basis", "field_index", F.col("expected")).agg(F.max("count").alias("n"), first, F.max("examples_omitted").alias("omitted"))


def health_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _inspected(spark, sf_dir, width=3, presence={2: "nonmissing", 3: "nonmissing"}, examples=0)
    return report.where("row_kind = 'finding' and basis = 'declared'").select("category", "field_index", "expected", F.col("count").alias("n"))


def _command(args: str, columns: str, table: str, lines: Callable[[DataFrame], DataFrame]) -> Query:
    """A command over a table written as lines of text, its output lines cut into the columns of a result."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "lines")
        lines(_table(spark, sf_dir, table)).select("value").write.text(path)
        out = language.run(spark, args.split(" "), path)
        separator = "," if "--csv" in args else " " if "--vnlog" in args else "\t"
        fields = F.split("value", separator, -1)
        made = out if "-H" not in args and "--vnlog" not in args else out.where(~F.col("value").rlike("GroupBy|^# "))
        return made.select(*[fields[i].cast(c.split(":")[1]).alias(c.split(":")[0]) for i, c in enumerate(columns.split(" "))])

    return query


def _joined(separator: str, *fields: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(F.concat_ws(separator, *fields).alias("value"))


def _with_header(header: str, separator: str, *fields: str) -> Callable[[DataFrame], DataFrame]:
    """Lines of one file whose first is the header."""

    def lines(df: DataFrame) -> DataFrame:
        body = df.select(F.concat_ws(separator, *fields).alias("value"), F.lit(1).alias("place"))
        top = df.sparkSession.createDataFrame([(header, 0)], "value string, place int")
        return top.unionByName(body).coalesce(1).sortWithinPartitions("place")

    return lines


_ORDER_FIELDS = ("o_orderkey", "o_custkey", "o_orderpriority")
COMMANDS: dict[str, Query] = {
    "txt_sorted": _command("-s -g 3 count 1 max 1 countunique 2", "k:string n:long most:long customers:long", "orders", _joined("\t", *_ORDER_FIELDS)),
    "txt_separator": _command("-t | -s -g 3 --output-delimiter=\t min 1 last 3", "k:string least:long last:string", "orders", _joined("|", *_ORDER_FIELDS)),
    "txt_whitespace": _command("-W -s -g 1 sum 2", "k:string total:long", "orders", _joined("   ", "o_orderstatus", "o_custkey")),
    "txt_comments": _command("-C -s -g 1 count 2", "k:string n:long", "orders", lambda df: df.select(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "# ").otherwise(""), "o_orderstatus", F.lit("\t"), "o_orderkey").alias("value"))),
    "txt_header": _command("-H -s -g status max key", "k:string most:long", "orders", _with_header("status\tkey", "\t", "o_orderstatus", "o_orderkey")),
    "txt_vnlog": _command("--vnlog -s -g status max key", "k:string most:long", "orders", _with_header("# status key", " ", "o_orderstatus", "o_orderkey")),
    "txt_csv": _command("--csv -H -s -g who sum key", "k:string total:long", "orders", _with_header('"who",key', ",", "o_orderpriority", "o_orderkey")),
    "txt_narm": _command("--narm -s -g 1 count 2 sum 2", "k:string n:long total:long", "orders", lambda df: df.select(F.concat_ws("\t", "o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "N/A").otherwise(F.col("o_custkey").cast("string"))).alias("value"))),
    "txt_cut": _command("cut 3,1", "priority:string key:long", "orders", _joined("\t", *_ORDER_FIELDS)),
    "txt_check": _command("check", "value:string", "orders", _joined("\t", *_ORDER_FIELDS)),
    "txt_reverse": _command("reverse", "priority:string customer:long key:long", "orders", _joined("\t", *_ORDER_FIELDS)),
    "txt_round": _command("-R 2 -s -g 1 mean 2", "k:string average:string", "nation", _joined("\t", "n_regionkey", "n_nationkey")),
    "txt_format": _command("-s -g 1 --format %08.1f sum 2", "k:string total:string", "nation", _joined("\t", "n_regionkey", "n_nationkey")),
    "txt_top": _command("-s -g 3 top:2 1", "key:long customer:long priority:string", "orders", _joined("\t", *_ORDER_FIELDS)),
    "txt_top_narm": _command(
        "--narm -i -s -g 2 bottom:1 1", "key:long priority:string", "orders",
        lambda df: df.select(F.concat_ws("\t", F.when(F.col("o_orderkey") % 3 == 0, "nan").otherwise(F.col("o_orderkey").cast("string")), F.when(F.col("o_custkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))).alias("value")),
    ),
    "txt_exact": _command("--exact --narm -s -g 1 sum 2 max 2", "k:string total:long most:long", "orders", lambda df: df.select(F.concat_ws("\t", "o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "NA").otherwise(F.col("o_custkey").cast("string"))).alias("value"))),
}


def agg_absmax_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("c_custkey") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    df = _table(spark, sf_dir, "customer").withColumn("v", value)
    return summarise(df, [op("absmin", "v", alias="least"), op("absmax", "v", alias="most")], ["c_nationkey"], "c_custkey").where("not isnan(least)")


QUERIES: dict[str, Query] = {
    **COMMANDS,
    **{f"agg_{k}": _grouped(t, key, k, fields, digits, param, rid) for k, (t, key, fields, param, digits, rid, _) in SUMMARIES.items()},
    "agg_mode": _grouped(*_BY_FLAG, "mode", ["l_quantity"], None),
    "agg_antimode": _grouped(*_BY_FLAG, "antimode", ["l_quantity"], None),
    **{f"row_{k}": _row_query(o, param, t, key, field, digits) for k, (o, param, t, key, field, _, digits) in ROWS.items()},
    "cmp_keyed": _compared(),
    "cmp_whole": _compared(keys=()),
    "cmp_ranked_abs": _compared(2, "absolute"),
    "cmp_ranked_pct": _compared(1, "percent", 2),
} | {
    f.__name__: f
    for f in (
        row_debase64, grp_sorted, grp_multi_key, grp_whole, grp_adjacent, grp_ignore_case, grp_full, grp_high_cardinality, narm_summary, narm_paired, rand_seeded, tbl_rmdup, tbl_check, tbl_reverse,
        tbl_transpose, tbl_noop, ct_count, ct_max, ct_unsorted, top_n, bottom_n, top_n_grouped, top_n_adjacent, health_counts, health_report, health_validate, agg_absmax_nan,
    )
}

_RUNS = "select *, sum(changed) over (order by event_id rows unbounded preceding) as gid from (select *, case when lag({0}) over (order by event_id) is not distinct from {0} then 0 else 1 end as changed from {1})"
_SIDES = (
    "select * replace (case when o_orderpriority = '5-LOW' then '5-LAST' else o_orderpriority end as o_orderpriority) from orders where o_orderdate < date '1998-01-01'",
    "select * replace (case when o_orderpriority = '1-URGENT' then '0-NOW' else o_orderpriority end as o_orderpriority) from orders where o_orderdate >= date '1998-01-01'",
)


def _compare_sql(keys: bool, state: str, order: str | None = None, limit: int | None = None) -> str:
    key = "o_orderpriority" if keys else "1"
    parts = ", ".join(
        f"b.{c} as {c}_before, a.{c} as {c}_after, round(a.{c}::double - b.{c}, 4) as {c}_difference, case when m then 'available' else 'not_matched' end as {c}_difference_state, "
        f"case when m then round((a.{c}::double - b.{c}) / b.{c} * 100, 4) end as {c}_percentage, case when not m then 'not_matched' when b.{c} = 0 then 'zero_baseline' else 'available' end as {c}_percentage_state"
        for c in ("n", "most")
    )
    shown = "coalesce(b.k, a.k) as o_orderpriority, " if keys else ""
    sides = [f"{x} as (select {key} as k, count(*) as n, max(o_totalprice) as most from ({s}) group by all)" for x, s in zip("ba", _SIDES)]
    sql = (
        f"with {', '.join(sides)} select {shown}case when m then 'matched' when b.k is not null then 'removed' else 'added' end as presence, {state} as rank_state, {parts} "
        "from b full outer join a on b.k = a.k cross join lateral (select b.k is not null and a.k is not null as m)"
    )
    if limit:
        sql = f"select * exclude (place) from (select *, case when rank_state = 'ranked' then row_number() over (partition by rank_state order by abs({order}) desc, o_orderpriority) else 0 end as place from ({sql})) where place <= {limit}"
    return sql


_MISSING_SQL = "(select event_id, event_type, case when event_id % 7 = 0 or event_type = 'view' then null else value end as v from events)"
_CELLS = """(select event_id as rid, pos, case when pos = 3 and event_id % 19 = 0 then null when pos = 1 then event_id::varchar when pos = 2 then event_type
  when event_id % 11 = 0 then '' when event_id % 13 = 0 then 'NA' when event_id % 17 = 0 then 'oops' else value::varchar end as v from events, range(1, 4) r(pos))"""
_CLASSED = f"""(select *, case when v is null then 'absent' when v = '' then 'empty' when lower(v) in ('na', 'n/a', 'nan') then 'missing'
  when regexp_full_match(v, '[+-]?[0-9]+') then 'integer' when try_cast(v as double) is not null then 'other_number' else 'text' end as class from {_CELLS})"""
_COUNTED = f"""(select pos, {', '.join(f"count(*) filter (class = '{c}') as {c}" for c in health.CLASSES)} from {_CLASSED} group by pos)"""
_TYPED = f"(select *, case when integer + other_number > text then case when other_number = 0 then 'integer' else 'number' end when text > integer + other_number then 'text' else 'undetermined' end as inferred from {_COUNTED})"

_MAYBE = "(select o_orderstatus as k, case when o_orderkey % 4 = 0 then null else o_custkey end as v from orders)"
ORACLES: dict[str, str] = {
    "txt_sorted": "select o_orderpriority as k, count(*) as n, max(o_orderkey) as most, count(distinct o_custkey) as customers from orders group by 1",
    "txt_separator": "select o_orderpriority as k, min(o_orderkey) as least, o_orderpriority as last from orders group by 1",
    "txt_whitespace": "select o_orderstatus as k, sum(o_custkey)::bigint as total from orders group by 1",
    "txt_comments": "select o_orderstatus as k, count(*) as n from orders where o_orderkey % 3 <> 0 group by 1",
    "txt_header": "select o_orderstatus as k, max(o_orderkey) as most from orders group by 1",
    "txt_vnlog": "select o_orderstatus as k, max(o_orderkey) as most from orders group by 1",
    "txt_csv": "select o_orderpriority as k, sum(o_orderkey)::bigint as total from orders group by 1",
    "txt_narm": f"select k, count(v) as n, sum(v)::bigint as total from {_MAYBE} group by 1",
    "txt_cut": "select o_orderpriority as priority, o_orderkey as key from orders",
    "txt_check": "select count(*)::varchar || ' lines, 3 fields' as value from orders",
    "txt_reverse": "select o_orderpriority as priority, o_custkey as customer, o_orderkey as key from orders",
    "txt_round": "select n_regionkey::varchar as k, printf('%.2f', avg(n_nationkey)) as average from nation group by 1",
    "txt_format": "select n_regionkey::varchar as k, printf('%08.1f', sum(n_nationkey)::double) as total from nation group by 1",
    "txt_top": "select o_orderkey as key, o_custkey as customer, o_orderpriority as priority from orders qualify row_number() over (partition by o_orderpriority order by o_orderkey desc) <= 2",
    "txt_top_narm": "select o_orderkey as key, case when o_custkey % 2 = 0 then lower(o_orderpriority) else o_orderpriority end as priority from orders where o_orderkey % 3 <> 0 qualify row_number() over (partition by lower(o_orderpriority) order by o_orderkey) = 1",
    "txt_exact": f"select k, sum(v)::bigint as total, max(v)::bigint as most from {_MAYBE} group by 1",
    "agg_absmax_nan": """select c_nationkey, arg_min(c_acctbal, abs(c_acctbal)) filter (c_custkey % 7 <> 3) as least, arg_max(c_acctbal, abs(c_acctbal)) filter (c_custkey % 7 <> 3) as most
  from customer group by 1 having min(c_custkey) % 7 <> 3""",
    **{f"agg_{k}": f"select {key}, {f'round({sql}, {digits})' if digits is not None else sql} as value from {t} group by {key}" for k, (t, key, _, _, digits, _, sql) in SUMMARIES.items()},
    **{
        f"agg_{k}": f"select l_returnflag, arg_min(l_quantity, ({sign}n, l_quantity)) as value from (select l_returnflag, l_quantity, count(*) as n from lineitem group by all) group by l_returnflag"
        for k, sign in (("mode", "-"), ("antimode", ""))
    },
    **{f"row_{k}": f"select {key}, {f'round({sql}, {digits})' if digits is not None else sql} as value from {t}" for k, (_, _, t, key, _, sql, digits) in ROWS.items() if sql},
    "row_debase64": "select c_custkey, c_name as value from customer",
    "grp_sorted": f"select l_returnflag, count(*) as n, round(sum({W}), 4) as total, round(avg({V}), 4) as average, round(median({V}), 4) as middle from lineitem group by 1",
    "grp_multi_key": f"select l_returnflag, l_linestatus, count(*) as n, round(quantile_cont({V}, 0.25), 4) as low, round(median({V}), 4) as middle, round(quantile_cont({V}, 0.75), 4) as high, round(quantile_cont({V}, 0.75) - quantile_cont({V}, 0.25), 4) as spread from lineitem group by 1, 2",
    "grp_whole": f"select round(sum({V}), 2) as total, round(avg({V}), 2) as average from lineitem",
    "grp_adjacent": f"select any_value(event_type) as event_type, count(*) as n, round(sum(value), 4) as total, min(event_id)::varchar as head from ({_RUNS.format('event_type', 'events')}) group by gid",
    "grp_ignore_case": "select arg_min(kind, event_id) as kind, count(*) as n, arg_min(kind, event_id) as spellings from (select event_id, case when event_id % 3 = 0 then upper(event_type) else event_type end as kind from events) group by lower(kind)",
    "grp_full": "select o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_totalprice as most from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders) where r = 1",
    "grp_high_cardinality": "select l_orderkey, count(*) as n, string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) as lines from lineitem group by 1",
    "narm_summary": f"select event_type, count(v) as n, coalesce(round(sum(v), 4), 0) as total, coalesce(min(v), '-inf'::double) as least, coalesce(max(v), 'inf'::double) as most, coalesce(round(avg(v), 4), 'nan'::double) as average from {_MISSING_SQL} group by 1",
    "narm_paired": "select sum(x.v * y.v)::double as value from (select event_id as v, row_number() over (order by event_id) as r from events where event_id % 5 <> 0) x join (select event_id * 2 as v, row_number() over (order by event_id) as r from events where event_id % 5 <> 1) y using (r)",
    "tbl_rmdup": "select arg_min(event_id, event_id) as event_id, user_id, arg_min(event_type, event_id) as event_type from events group by user_id",
    "tbl_check": "select count(*) as n_lines, 6::bigint as n_fields from orders",
    "tbl_reverse": "select n_regionkey, n_name, n_nationkey from nation",
    "tbl_transpose": "select 0::bigint as pos, string_agg(n_nationkey::varchar, '|' order by n_nationkey) as row from nation union all select 1, string_agg(n_name, '|' order by n_nationkey) from nation union all select 2, string_agg(n_regionkey::varchar, '|' order by n_nationkey) from nation",
    "tbl_noop": "select * from region where false",
    "ct_count": "select o_orderpriority, " + ", ".join(f"coalesce(nullif(count(*) filter (o_orderstatus = '{s}'), 0)::varchar, 'N/A') as \"{s}\"" for s in "FOP") + " from orders group by 1",
    "ct_max": "select l_returnflag, " + ", ".join(f"coalesce((max(l_linenumber) filter (l_linestatus = '{s}'))::varchar, 'N/A') as \"{s}\"" for s in "FOX") + " from lineitem group by 1",
    "ct_unsorted": "with runs as (select any_value(event_type) as event_type, any_value(side) as side, gid, count(*) as n from ("
    + _RUNS.format("(event_type || side)", "(select *, case when user_id % 2 = 0 then 'even' else 'odd' end as side from events)")
    + ") group by gid) select event_type, " + ", ".join(f"coalesce((arg_min(n, gid) filter (side = '{s}'))::varchar, 'N/A') as \"{s}\"" for s in ("even", "odd")) + " from runs group by 1",
    "top_n": "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "bottom_n": "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 25",
    "top_n_grouped": "select o_orderkey, o_orderpriority, o_totalprice from orders qualify row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) <= 5",
    "top_n_adjacent": f"select event_id, event_type, value from ({_RUNS.format('event_type', 'events')}) qualify row_number() over (partition by gid order by value desc, event_id) = 1",
    "cmp_keyed": _compare_sql(True, "'not_requested'"),
    "cmp_whole": _compare_sql(False, "'not_requested'"),
    "cmp_ranked_abs": _compare_sql(True, "case when m then 'ranked' else 'one_sided' end"),
    "cmp_ranked_pct": _compare_sql(True, "case when m then 'ranked' else 'one_sided' end", "n_percentage", 2),
    "health_counts": f"select pos, {', '.join(health.CLASSES)}, inferred from {_TYPED}",
    "health_report": f"""with found as (
  select 'absent_field' as category, 'observation' as basis, pos as field_index, '' as expected, rid from {_CLASSED} where class = 'absent'
  union all select 'empty_field', 'observation', pos, '', rid from {_CLASSED} where class = 'empty'
  union all select 'missing_indicator', 'observation', pos, '', rid from {_CLASSED} where class = 'missing'
  union all select 'width_mismatch', 'inferred', null, '3', event_id from events where event_id % 19 = 0
  union all select 'type_mismatch', 'declared', pos, 'integer', rid from {_CLASSED} where pos in (1, 3) and class in ('other_number', 'text')
  union all select 'presence_mismatch', 'declared', pos, 'required', rid from {_CLASSED} where pos = 3 and class in ('absent', 'empty'))
  select category, basis, field_index, expected, count(*) as n, min(rid) as first_row, count(*) - 1 as omitted from found group by all
  union all select 'mixed_types', 'observation', pos, '', 1, min(rid), count(*) - 1 from {_CLASSED} where class in ('integer', 'other_number', 'text') group by pos having count(distinct class = 'text') = 2""",
    "health_validate": f"""select 'width_mismatch' as category, null::bigint as field_index, '3' as expected, count(*) as n from events where event_id % 19 = 0
  union all select 'presence_mismatch', pos, 'nonmissing', count(*) from {_CLASSED} where pos in (2, 3) and class in ('absent', 'empty', 'missing') group by pos""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
