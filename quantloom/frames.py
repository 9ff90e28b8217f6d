"""Keyed, ordered window expressions, written once for the SQL of Spark and of a checking engine.

Operators are relations: functions that take a source relation and return SQL over it.  `Series` renders their frames:
R(n) is n rows ending at the current one, P(n) the n rows strictly before it, F(n) the n rows after it.  Rolling values
are null until the frame holds n non-null values.  All expressions that share a window share its sort.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    """The few functions whose names or arguments differ."""

    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def quantile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})" if self.spark else f"quantile_cont({x}, {p})"

    def days(self, end: str, start: str) -> str:
        return f"datediff({end}, {start})" if self.spark else f"date_diff('day', {start}, {end})"

    def weekday(self, x: str) -> str:
        """0 for Monday to 6 for Sunday."""
        return f"weekday({x})" if self.spark else f"(isodow({x}) - 1)"

    def isoweek(self, x: str) -> str:
        return f"weekofyear({x})" if self.spark else f"week({x})"

    def plus_days(self, x: str, n: str | int) -> str:
        return f"date_add({x}, cast({n} as int))" if self.spark else f"({x} + to_days(cast({n} as int)))"

    def plus_months(self, x: str, n: str | int) -> str:
        return f"add_months({x}, cast({n} as int))" if self.spark else f"cast({x} + to_months(cast({n} as int)) as date)"

    def bucket(self, x: str, minutes: int) -> str:
        """The start of the time's bucket of so many minutes; buckets begin with the day."""
        if not self.spark:
            return f"time_bucket(interval '{minutes} minutes', {x}, timestamp '2000-01-01')"
        into = f"cast(floor((hour({x}) * 60 + minute({x})) / {minutes}) * {minutes} as int)"
        return f"cast(timestampadd(MINUTE, {into}, date_trunc('day', {x})) as timestamp_ntz)"

    def series(self, a: str, b: str) -> str:
        """The integers from a to b, as a list."""
        return f"sequence({a}, {b})" if self.spark else f"range({a}, {b} + 1)"

    def explode(self, array: str, name: str) -> str:
        return f"explode({array}) as {name}" if self.spark else f"unnest({array}) as {name}"

    def collect(self, x: str) -> str:
        return f"collect_list({x})" if self.spark else f"list({x})"

    def fn(self, v: str, body: str) -> str:
        return f"{v} -> {body}" if self.spark else f"lambda {v}: {body}"

    def transform(self, a: str, v: str, body: str) -> str:
        return f"{'transform' if self.spark else 'list_transform'}({a}, {self.fn(v, body)})"

    def filter(self, a: str, v: str, body: str) -> str:
        return f"{'filter' if self.spark else 'list_filter'}({a}, {self.fn(v, body)})"

    def fold(self, a: str, start: str, acc: str, v: str, body: str) -> str:
        """Fold a list of doubles from the left."""
        return f"aggregate({a}, cast({start} as double), ({acc}, {v}) -> {body})" if self.spark else f"list_reduce(list_prepend(cast({start} as double), {a}), lambda {acc}, {v}: {body})"

    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"len({a})"

    def total(self, a: str) -> str:
        return f"aggregate({a}, cast(0 as double), (acc, x) -> acc + x)" if self.spark else f"coalesce(list_sum({a}), 0.0)"

    def item(self, a: str, i: str | int) -> str:
        """The i-th item, from 1; null beyond the end."""
        return f"try_element_at({a}, cast({i} as int))" if self.spark else f"({a})[{i}]"

    def matches(self, x: str, pattern: str, group: int) -> str:
        p = pattern.replace("\\", "\\\\") if self.spark else pattern
        return f"regexp_extract({x}, '{p}', {group})"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')" if self.spark else f"json_extract_string({x}, '$.{key}')"

    def counts(self, cond: str) -> str:
        return f"count_if({cond})"

    def first(self, x: str, *order: str) -> str:
        """The value of the row that is first by a total order."""
        return f"min_by({x}, struct({', '.join(order)}))" if self.spark else f"first({x} order by {', '.join(order)})"

    def last(self, x: str, *order: str) -> str:
        return f"max_by({x}, struct({', '.join(order)}))" if self.spark else f"last({x} order by {', '.join(order)})"

    def ratio(self, a: str, b: str) -> str:
        """a / b of doubles, by zero too: infinite, or not a number, as the checking engine has it; Spark's division fails there."""
        return f"if({b} = 0, {a} * double('infinity'), {a} / {b})" if self.spark else f"{a} / {b}"

    def sign(self, x: str) -> str:
        """-1, 0 or 1; 0 for what is not a number."""
        return f"case when isnan({x}) then cast(0 as double) else sign({x}) end" if self.spark else f"sign({x})"

    def mean(self, x: str) -> str:
        """The mean of a small group's non-null doubles; in Spark summed in their order, so that equal groups have equal means."""
        return f"aggregate(array_sort(collect_list({x})), cast(0 as double), (acc, v) -> acc + v) / nullif(count({x}), 0)" if self.spark else f"avg({x})"

    def last_seen(self, x: str) -> str:
        return f"last({x}, true)" if self.spark else f"last_value({x} ignore nulls)"

    def seconds(self, x: str) -> str:
        return f"unix_seconds(cast({x} as timestamp))" if self.spark else f"cast(floor(epoch({x})) as bigint)"

    def fence(self, source: str, *columns: str) -> str:
        """The columns of a source, computed once a row: Spark doesn't push a filter's copies of their formulas below it."""
        names = ", ".join(columns)
        return f"(select inline(array(struct({names}))) from {source} fenced)" if self.spark else f"(select {names} from {source} fenced)"

    def broadcast(self, *names: str) -> str:
        return ""


SPARK, DUCK = Dialect("spark"), Dialect("duck")


@dataclass(frozen=True)
class Series:
    """Windows over one instrument's rows in time."""

    d: Dialect
    keys: Sequence[str] = ("symbol",)
    order: Sequence[str] = ("ts",)
    extra: Sequence[str] = field(default=())

    def _over(self, frame: str = "") -> str:
        return f"over (partition by {', '.join([*self.keys, *self.extra])} order by {', '.join(self.order)}{frame})"

    @property
    def W(self) -> str:
        return self._over()

    def R(self, n: int) -> str:
        return self._over(f" rows between {n - 1} preceding and current row")

    def P(self, n: int) -> str:
        return self._over(f" rows between {n} preceding and 1 preceding")

    def F(self, n: int) -> str:
        return self._over(f" rows between 1 following and {n} following")

    @property
    def U(self) -> str:
        return self._over(" rows between unbounded preceding and current row")

    @property
    def B(self) -> str:
        """All rows before the current one."""
        return self._over(" rows between unbounded preceding and 1 preceding")

    def lag(self, x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) {self.W}"

    def lead(self, x: str, k: int = 1) -> str:
        return f"lead({x}, {k}) {self.W}"

    def roll(self, agg: str, x: str, n: int, least: int | None = None, past: bool = False) -> str:
        """agg(x) over a full frame of n rows; `least` non-null values instead of n; `past` excludes the current row."""
        frame = self.P(n) if past else self.R(n)
        return f"case when count({x}) {frame} >= {least or n} then {agg.format(x) if '{}' in agg else f'{agg}({x})'} {frame} end"

    def z(self, x: str, n: int, floor: float = 1e-12, clip: float = 10.0) -> str:
        """z-score of x in its frame, by a floored deviation, clipped."""
        m, s = self.roll("avg", x, n), self.roll("stddev_samp", x, n)
        return f"greatest(-{clip}, least({clip}, ({x} - {m}) / greatest({s}, {floor})))"

    def twice_rank(self, x: str, n: int) -> str:
        """Twice the average rank of the frame's last value, a whole number."""
        d = self.d
        a = f"{d.collect(x)} {self.R(n)}"
        less, same = d.size(d.filter(a, "v", f"v < {x}")), d.size(d.filter(a, "v", f"v = {x}"))
        return f"case when count({x}) {self.R(n)} = {n} then 2 * {less} + {same} + 1 end"

    def pct_rank(self, x: str, n: int) -> str:
        """Average rank of the frame's last value, as a share of n."""
        return f"({self.twice_rank(x, n)}) / cast({2 * n} as double)"


def staged(source: str, *stages: Mapping[str, str]) -> str:
    """Add columns in stages: a stage may use the columns of those before it."""
    sql = source
    for k, columns in enumerate(stages):
        sql = f"(select *, {', '.join(f'{v} as {n}' for n, v in columns.items())} from {sql} t{k})"
    return sql


def output(source: str, keys: Sequence[str], rounded: Sequence[str] = (), plain: Sequence[str] = (), digits: int = 6) -> str:
    """The keys, plain columns, and columns rounded for display; adding zero turns -0 into 0."""
    return f"select {', '.join([*keys, *plain, *(f'round(cast({c} as double), {digits}) + cast(0 as double) as {c}' for c in rounded)])} from {source} o"


_NAME = re.compile(r"\{(\w+)\}")


def spark_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL whose {names} stand for DataFrames."""
    used = {n: tables[n] for n in set(_NAME.findall(sql))}
    return spark.sql(sql, **used)


def apply(operator: Callable, df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), **params) -> DataFrame:
    """Run a series operator over any DataFrame: operator(series, source, **params) gives the SQL."""
    sql = operator(Series(SPARK, tuple(keys), tuple(order)), "{source}", **params)
    return spark_sql(df.sparkSession, sql if sql.lstrip().startswith("select") else f"select * from {sql} t", source=df)
