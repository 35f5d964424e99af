"""Random rows from field expressions: a data source for batches and streams, and a lookup.

Options: fields.<name>.expression, .null-rate (0 to 1) and .length; number-of-rows (unbounded streams without),
rows-per-second, most-rows, partitions, seed. Map columns take .key.expression and .value.expression; arrays take an expression, or
those of their elements' fields if these are rows. Equal seeds give equal rows.

A stream with number-of-rows brings all of them; one without brings rows-per-second rows for each second, no more than most-rows
at once; one that starts again goes on where it was. Rows are made in the tasks, whose number is partitions.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType, TimestampNTZType, TimestampType

from .custom import Paced

# Words for generated names.
HEROES = ("Amber Comet", "Captain Lattice", "Doctor Tundra", "Iron Sparrow", "Lady Meridian", "Night Ledger", "The Archivist")
POWERS = ("flight", "foresight", "frost", "invisibility", "magnetism", "speed", "telepathy")
SPELLS = ("Aperio", "Claritas", "Fulgor", "Levitum", "Nox Minor", "Obscuro", "Silentia")
_CALL = re.compile(r"#\{\s*([\w.]+)\s*((?:'(?:[^']|'')*'\s*,?\s*)*)\}")


def _from_pattern(rng: random.Random, pattern: str) -> str:
    """A string of a regular expression with literals, classes, \\d, \\w and {n} or {n,m}."""
    out, at = [], 0
    while at < len(pattern):
        if pattern[at] == "[":
            end = pattern.index("]", at + 1)
            chars = re.sub(r"(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), pattern[at + 1 : end])
            at = end + 1
        elif pattern[at] == "\\":
            chars = {"d": string.digits, "w": string.ascii_letters + string.digits + "_"}.get(pattern[at + 1], pattern[at + 1])
            at += 2
        else:
            chars, at = pattern[at], at + 1
        times = 1
        if (m := re.match(r"\{(\d+)(?:,(\d+))?\}", pattern[at:])):
            times, at = rng.randint(int(m[1]), int(m[2] or m[1])), at + m.end()
        out += [rng.choice(chars) for _ in range(times)]
    return "".join(out)


def _past(rng: random.Random, args: list[str], now: datetime) -> str:
    """A time before now: at most the first number of units ago, and at least the second, if there are two."""
    unit = {"SECONDS": 1, "MINUTES": 60, "HOURS": 3600, "DAYS": 86400}[args[-1].upper()]
    most, least = int(args[0]) * unit, int(args[1]) * unit if len(args) > 2 else 0
    return (now - timedelta(seconds=rng.uniform(least, max(most, least)))).isoformat(sep=" ", timespec="milliseconds")


def calls(now: datetime) -> dict[str, Callable[[random.Random, list[str]], str]]:
    return {
        "number.numberBetween": lambda r, a: str(r.randrange(int(a[0]), max(int(a[1]), int(a[0]) + 1))),
        "number.randomDouble": lambda r, a: f"{r.uniform(float(a[1]), float(a[2])):.{int(a[0])}f}",
        "regexify": lambda r, a: _from_pattern(r, a[0]),
        "letterify": lambda r, a: "".join(r.choice(string.ascii_lowercase) if c == "?" else c for c in a[0]),
        "numerify": lambda r, a: "".join(r.choice(string.digits) if c == "#" else c for c in a[0]),
        "options.option": lambda r, a: r.choice(a),
        "bool.bool": lambda r, a: r.choice(("true", "false")),
        "superhero.name": lambda r, a: r.choice(HEROES),
        "superhero.power": lambda r, a: r.choice(POWERS),
        "harry_potter.spell": lambda r, a: r.choice(SPELLS),
        "date.past": lambda r, a: _past(r, a, now),
        "internet.emailAddress": lambda r, a: "".join(r.choices(string.ascii_lowercase, k=8)) + f"{r.randrange(100)}@example.com",
        "internet.ipV4Address": lambda r, a: ".".join(str(r.randrange(256)) for _ in range(4)),
        "internet.ipV6Address": lambda r, a: ":".join(f"{r.randrange(1 << 16):x}" for _ in range(8)),
        "phoneNumber.phoneNumber": lambda r, a: f"({r.randrange(200, 1000)}) 555-{r.randrange(10_000):04d}",
        "phoneNumber.cellPhone": lambda r, a: f"555-{r.randrange(1000):03d}-{r.randrange(10_000):04d}",
    }


def evaluate(expression: str, rng: random.Random, now: datetime) -> str:
    known = calls(now)

    def one(m: re.Match) -> str:
        if m[1] not in known:
            raise ValueError(f"no such generator: {m[1]}")
        return known[m[1]](rng, [x.replace("''", "'") for x in re.findall(r"'((?:[^']|'')*)'", m[2])])

    return _CALL.sub(one, expression)


#: Whole numbers of 8, 16, 32 and 64 bits, and the types that an expression can be read as.
WHOLE = (ByteType, ShortType, IntegerType, LongType)
SIMPLE = (*WHOLE, BinaryType, BooleanType, DateType, DecimalType, DoubleType, FloatType, StringType, TimestampNTZType, TimestampType)


def cast(text: str, kind: DataType) -> Any:
    if isinstance(kind, WHOLE):
        whole = int(Decimal(text))
        bits = 8 << WHOLE.index(type(kind))
        if not -(1 << (bits - 1)) <= whole < 1 << (bits - 1):
            raise ValueError(f"{text} is no {kind.simpleString()}")
        return whole
    if isinstance(kind, DecimalType):
        return round(Decimal(text), kind.scale)
    if isinstance(kind, DateType):
        return date.fromisoformat(text.strip()[:10])
    if isinstance(kind, (DoubleType, FloatType)):
        return float(text)
    if isinstance(kind, BooleanType):
        return text.lower() == "true"
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        at = datetime.fromisoformat(text)
        return at if isinstance(kind, TimestampNTZType) else at.replace(tzinfo=timezone.utc)
    return text.encode() if isinstance(kind, BinaryType) else text


class Fields:
    """Checked options of a schema's fields."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.options = {k.lower(): v for k, v in options.items()}
        for f in schema.fields:
            self._check(f"fields.{f.name}".lower(), f.dataType)

    def _check(self, at: str, kind: DataType) -> None:
        rate = float(self.options.get(f"{at}.null-rate", 0))
        if not 0 <= rate <= 1:
            raise ValueError(f"{at}.null-rate must be from 0 to 1")
        if isinstance(kind, StructType):
            for f in kind.fields:
                self._check(f"{at}.{f.name}".lower(), f.dataType)
        elif isinstance(kind, MapType):
            self._check(f"{at}.key", kind.keyType)
            self._check(f"{at}.value", kind.valueType)
        elif isinstance(kind, ArrayType):
            self._check(at, kind.elementType)
        elif not isinstance(kind, SIMPLE):
            raise ValueError(f"{at}: no values of type {kind.simpleString()} can be made")
        elif f"{at}.expression" not in self.options:
            raise ValueError(f"{at}.expression is missing")

    def _value(self, at: str, kind: DataType, rng: random.Random, now: datetime) -> Any:
        if rng.random() < float(self.options.get(f"{at}.null-rate", 0)):
            return None
        n = int(self.options.get(f"{at}.length", 1))
        if isinstance(kind, StructType):
            return tuple(self._value(f"{at}.{f.name}".lower(), f.dataType, rng, now) for f in kind.fields)
        if isinstance(kind, MapType):
            return {self._value(f"{at}.key", kind.keyType, rng, now): self._value(f"{at}.value", kind.valueType, rng, now) for _ in range(n)}
        if isinstance(kind, ArrayType):
            return [self._element(at, kind.elementType, rng, now) for _ in range(n)]
        return cast(evaluate(self.options[f"{at}.expression"], rng, now), kind)

    def _element(self, at: str, kind: DataType, rng: random.Random, now: datetime) -> Any:
        """An element of an array: its options are those of the array, but null-rate and length."""
        if isinstance(kind, StructType):
            return tuple(self._value(f"{at}.{f.name}".lower(), f.dataType, rng, now) for f in kind.fields)
        return cast(evaluate(self.options[f"{at}.expression"], rng, now), kind)

    def row(self, number: int) -> tuple:
        rng = random.Random(f"{self.options.get('seed', '0')}:{number}")
        now = datetime(2024, 1, 1) if "seed" in self.options else datetime.now(timezone.utc).replace(tzinfo=None)
        return tuple(self._value(f"fields.{f.name}".lower(), f.dataType, rng, now) for f in self.schema.fields)


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class FakerReader(DataSourceReader):
    def __init__(self, fields: Fields):
        self.fields = fields

    def partitions(self) -> list[InputPartition]:
        n, parts = int(self.fields.options.get("number-of-rows", -1)), int(self.fields.options.get("partitions", 4))
        if n < 0:
            raise ValueError("a batch needs number-of-rows")
        return [Range(n * i // parts, n * (i + 1) // parts) for i in range(parts)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return (self.fields.row(i) for i in range(partition.start, partition.end))


class FakerStream(DataSourceStreamReader):
    """Offsets are numbers of rows; without number-of-rows they follow the clock, most-rows at once at most."""

    def __init__(self, fields: Fields):
        self.fields = fields
        self.most = int(fields.options.get("number-of-rows", -1))
        self.pace = Paced(fields.options)

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": self.most if self.most >= 0 else self.pace.latest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.pace.reached(end["row"])
        a, n, parts = start["row"], end["row"] - start["row"], int(self.fields.options.get("partitions", 4))
        return [Range(a + n * i // parts, a + n * (i + 1) // parts) for i in range(parts)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return (self.fields.row(i) for i in range(partition.start, partition.end))


class Faker(DataSource):
    @classmethod
    def name(cls) -> str:
        return "faker"

    def schema(self) -> StructType:
        raise ValueError("faker needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return FakerReader(Fields(schema, dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FakerStream(Fields(schema, dict(self.options)))


def scan(spark: SparkSession, schema: str, options: dict[str, str]) -> DataFrame:
    spark.dataSource.register(Faker)
    return spark.read.format("faker").schema(schema).options(**options).load()


def lookup(df: DataFrame, keys: list[str], schema: str, options: dict[str, str]) -> DataFrame:
    """One generated row for each row of df: the keys as they are, the other columns random. Equal keys get equal rows."""
    kinds = StructType.fromDDL(schema)
    rest = StructType([f for f in kinds.fields if f.name not in keys])
    fields = Fields(rest, options)

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            rows = batch.to_pylist()
            made = [fields.row(hash_of([r[k] for k in keys])) for r in rows]
            columns = [pa.array([r[f.name] for r in rows]).cast(batch.schema.field(f.name).type) if f.name in keys else pa.array([m[rest.fieldNames().index(f.name)] for m in made], to_arrow_type(f.dataType)) for f in kinds.fields]
            yield pa.RecordBatch.from_arrays(columns, names=kinds.fieldNames())

    return df.select(*keys).mapInArrow(run, kinds)


def hash_of(values: list) -> int:
    import zlib

    return zlib.crc32(repr(values).encode())


def register_lookup(spark: SparkSession, name: str, keys: list[str], schema: str, options: dict[str, str]) -> None:
    """Makes a table function known to SQL for lateral joins: of the keys' values the row that lookup gives."""
    kinds = StructType.fromDDL(schema)
    rest = [f.name for f in kinds.fields if f.name not in keys]
    fields = Fields(StructType([kinds[c] for c in rest]), options)

    class Lookup:
        def eval(self, *values: Any) -> Iterator[tuple]:
            made = dict(zip([*keys, *rest], [*values, *fields.row(hash_of(list(values)))], strict=True))
            yield tuple(made[f.name] for f in kinds.fields)

    spark.udtf.register(name, F.udtf(Lookup, returnType=kinds))
