"""Record-level work: query building, validation, transformation, profiling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns of the validators (fixed values).
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$"
FORM_PHONE = r"^\d{3}-\d{3}-\d{4}$"
USER_NAME = r"^[a-zA-Z]+$"


@dataclass
class QueryBuilder:
    """A fluent SELECT: columns, source, joins, conditions (AND), groups, order, limit and named parameters."""

    columns: list[str] = field(default_factory=list)
    source: str = ""
    joins: list[str] = field(default_factory=list)
    conditions: list[str] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    having_: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    limit_: int | None = None
    offset_: int | None = None
    params: dict = field(default_factory=dict)

    def select(self, *columns: str) -> QueryBuilder:
        self.columns += columns
        return self

    def from_(self, table: str) -> QueryBuilder:
        self.source = table
        return self

    def join(self, table: str, on: str, kind: str = "INNER") -> QueryBuilder:
        self.joins.append(f"{kind} JOIN {table} ON {on}")
        return self

    def where(self, condition: str, **params) -> QueryBuilder:
        self.conditions.append(condition)
        self.params |= params
        return self

    def group_by(self, *columns: str) -> QueryBuilder:
        self.groups += columns
        return self

    def having(self, condition: str, **params) -> QueryBuilder:
        self.having_.append(condition)
        self.params |= params
        return self

    def order_by(self, *columns: str) -> QueryBuilder:
        self.order += columns
        return self

    def limit(self, n: int, offset: int | None = None) -> QueryBuilder:
        self.limit_, self.offset_ = n, offset
        return self

    def build(self) -> tuple[str, dict]:
        if not self.source:
            raise ValueError("a query needs a source table")
        parts = [f"SELECT {', '.join(self.columns) or '*'}", f"FROM {self.source}", *self.joins]
        parts += [f"WHERE {' AND '.join(self.conditions)}"] * bool(self.conditions)
        parts += [f"GROUP BY {', '.join(self.groups)}"] * bool(self.groups)
        parts += [f"HAVING {' AND '.join(self.having_)}"] * bool(self.having_)
        parts += [f"ORDER BY {', '.join(self.order)}"] * bool(self.order)
        parts += [f"LIMIT {self.limit_}"] * (self.limit_ is not None)
        parts += [f"OFFSET {self.offset_}"] * (self.offset_ is not None)
        return " ".join(parts), dict(self.params)

    def run(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        """Runs it over the given tables (or registered ones); values travel as parameters, never as text."""
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        sql, params = self.build()
        return spark.sql(sql, args=params)


def is_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL), F.lit(False))


def is_phone(c: Column) -> Column:
    return F.coalesce(F.replace(c, F.lit(" "), F.lit("")).rlike(PHONE), F.lit(False))


def in_range(c: Column, low: float, high: float) -> Column:
    return F.coalesce(c.cast("double").between(low, high), F.lit(False))


def in_dates(c: Column, first: str, last: str) -> Column:
    return F.coalesce(F.try_to_timestamp(c).between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")), F.lit(False))


def luhn(number: Column) -> Column:
    """The card checksum over the digits of a text; false without digits."""
    digits = F.reverse(F.regexp_replace(number, "[^0-9]", ""))
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def add(total: Column, at: Column) -> Column:
        digit = F.coalesce(F.substring(digits, at, F.lit(1)).try_cast("int"), F.lit(0))
        twice = digit * 2
        return total + F.when(at % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.coalesce((F.length(digits) > 0) & (F.aggregate(places, F.lit(0), add) % 10 == 0), F.lit(False))


def clean_text(c: Column) -> Column:
    """Trimmed, lower case, letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"[ \t\n\r\f\x0B]+", " "))


def full_years(born: Column, on: Column) -> Column:
    """Birthdays passed between two dates."""
    early = (F.month(on) < F.month(born)) | ((F.month(on) == F.month(born)) & (F.day(on) < F.day(born)))
    return (F.year(on) - F.year(born) - F.when(early, 1).otherwise(0)).cast("long")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def strip_scripts(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")


def shortened(c: Column, most: int, tail: str = "...") -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - len(tail)), F.lit(tail)))


def password_strength(c: Column) -> Column:
    """One point each for 8 and 12 characters, lower case, upper case, a digit and another character."""
    tests = [F.length(c) >= 8, F.length(c) >= 12, c.rlike("[a-z]"), c.rlike("[A-Z]"), c.rlike("[0-9]"), c.rlike("[^a-zA-Z0-9]")]
    return sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0))


def min_max(df: DataFrame, value: str, out: str = "normalised") -> DataFrame:
    """Adds the value scaled to 0..1 over the whole table (0 where all are equal); one small aggregate is broadcast."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    return df.join(F.broadcast(bounds)).withColumn(out, scaled).drop("_lo", "_hi")


def number_statistics(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    v = F.col(value).cast("double")
    return df.groupBy(*(by or [])).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))


def profile(df: DataFrame) -> DataFrame:
    """One row a column: total, nulls, distinct values (as text) and completeness; one aggregation for all columns."""
    names = df.columns
    parts = [F.count("*").alias("_total")]
    for k, name in enumerate(names):
        parts += [F.count_if(F.col(f"`{name}`").isNull()).alias(f"n{k}"), F.count_distinct(F.col(f"`{name}`").cast("string")).alias(f"d{k}")]
    one = df.agg(*parts)
    rows = F.array(*[F.struct(F.lit(name).alias("field"), F.col("_total").alias("total"), F.col(f"n{k}").alias("nulls"), F.col(f"d{k}").alias("distinct_values")) for k, name in enumerate(names)])
    flat = one.select(F.explode(rows).alias("r")).select("r.*")
    return flat.withColumn("completeness", F.when(F.col("total") > 0, 1 - F.col("nulls") / F.col("total")).otherwise(F.lit(0.0)))


@dataclass
class Registry:
    """Named transformers (column to column) and validators (column to boolean), applied to fields of records.

    Records that fail a validator keep their row with the failed rules in
    ``errors``; ``valid`` and ``invalid`` split them.
    """

    transformers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    validators: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def process(self, df: DataFrame, transform: dict[str, str], validate: dict[str, str]) -> DataFrame:
        rules = [F.when(~F.coalesce(self.validators[rule](F.col(name)), F.lit(False)), F.lit(f"{name}: {rule}")) for name, rule in validate.items()]
        checked = df.withColumn("errors", F.filter(F.array(*rules), lambda e: e.isNotNull()) if rules else F.array().cast("array<string>"))
        return checked.withColumns({name: self.transformers[rule](F.col(name)) for name, rule in transform.items()})

    @staticmethod
    def valid(df: DataFrame) -> DataFrame:
        return df.where(F.size("errors") == 0)

    @staticmethod
    def invalid(df: DataFrame) -> DataFrame:
        return df.where(F.size("errors") > 0)


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as columns with joined names."""
    from pyspark.sql.types import StructType

    def walk(schema: StructType, path: list[str]) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            here = [*path, f.name]
            out += walk(f.dataType, here) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here))]
        return out

    return df.select(*walk(df.schema, []))


def sliced(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size``."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(size))
    return F.when(F.size(values) > 0, F.transform(starts, lambda s: F.slice(values, s, F.lit(size)))).otherwise(F.slice(F.array(values), 1, 0))


def merged_maps(*maps: Column) -> Column:
    """One map of all entries; the last one of a key wins."""
    entries = F.flatten(F.array(*[F.map_entries(m) for m in maps]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]), -1)
    return F.map_from_arrays(keys, F.transform(keys, last))
