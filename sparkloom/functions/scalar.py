"""The scalar library: strings, dates as yyyymmdd integers, clocks, numbers, hashing. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

# The alphabets of the constants.
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LETTERS = ASCII_LOWER + ASCII_UPPER
DIGITS, HEX_DIGITS, OCTAL_DIGITS = "0123456789", "0123456789abcdefABCDEF", "01234567"
MAX_INT = 2**31 - 1
NANOS = 1_000_000_000


def _quoted(s: Column | str) -> Column:
    return s if isinstance(s, Column) else F.lit(s)


def split_string(s: Column, separator: str) -> Column:
    return F.split(s, "\\Q" + separator + "\\E")


def take_until(s: Column, separator: str) -> Column:
    return F.substring_index(s, separator, 1)


def count_char(s: Column, char: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def slice_string(s: Column, start: int, end: int) -> Column:
    """Characters from start up to, not with, end; both are clamped to the string."""
    lo = max(0, start)
    return F.substring(s, lo + 1, max(0, end - lo))


def prefix(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def strcomp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def regex_matches(s: Column, pattern: str) -> Column:
    """All matches, as an array."""
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def regex_full_match(s: Column, pattern: str) -> Column:
    """1 if the whole string matches, else 0."""
    return s.rlike(f"^(?:{pattern})\\z").cast("int")


def ord_of(s: Column) -> Column:
    return F.ascii(s)


def char_of(n: Column) -> Column:
    """Character of a code; null outside of 0 to 255."""
    return F.when(n.between(0, 255), F.char(n))


def reverse_characters(s: Column) -> Column:
    return F.reverse(s)


def reverse_words(s: Column) -> Column:
    return F.array_join(F.reverse(F.split(s, " ")), " ")


def real_to_text(x: Column) -> Column:
    """Six decimals."""
    return F.format_string("%.6f", x.cast("double"))


def pack_record(x: Column) -> Column:
    """A record as a self-contained text that `parse_packed` reads back, nulls and nesting included."""
    return F.to_json(x, {"ignoreNullFields": "false"})


def parse_packed(s: Column, schema: str) -> Column:
    """The record of a packed text; fields that don't fit are null."""
    return F.from_json(s, schema)


def parse_psv(line: Column, schema: str) -> Column:
    return from_csv(line, schema, "|")


def to_json(x: Column) -> Column:
    return F.to_json(x)


def from_csv(line: Column, schema: str, separator: str = ",") -> Column:
    return F.from_csv(line, schema, {"sep": separator})


def date_to_int(d: Column) -> Column:
    """Date or timestamp to yyyymmdd."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def text_to_date_int(s: Column) -> Column:
    """'yyyy-mm-dd' to yyyymmdd; null for anything else."""
    return date_to_int(F.try_to_date(s, "yyyy-MM-dd"))


def parse_sql_date(s: Column) -> Column:
    """As text_to_date_int, but an error for what is no date."""
    bad = F.raise_error(F.concat(F.lit("not a date: "), s)).cast("int")
    return F.when(s.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(text_to_date_int(s), bad))


def date_int_to_text(n: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", _part(n, 10000, 10000), _part(n, 100, 100), _part(n, 1, 100))


def _part(n: Column, unit: int, size: int) -> Column:
    return F.pmod(F.floor(n / unit), F.lit(size)).cast("int")


def date_part(part: str, n: Column) -> Column:
    """day, month or year of yyyymmdd."""
    unit, size = {"day": (1, 100), "month": (100, 100), "year": (10000, 10000)}[part]
    return _part(n, unit, size)


def parse_date(s: Column, pattern: str) -> Column:
    """{y, m, d} of a text in a pattern; null for anything else."""
    return date_parts(F.try_to_date(s, pattern))


def date_parts(d: Column) -> Column:
    """{y, m, d} of a date or timestamp."""
    return F.when(d.isNotNull(), F.struct(F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d")))


def in_zone(t: Column, zone: str | None, given: str | None = None) -> Column:
    """A timestamp as clocks of a time zone show it; `given` is the zone its own clock stands for, the session's without it."""
    return F.convert_timezone(F.lit(given) if given else F.current_timezone(), F.lit(zone), t.cast("timestamp_ntz")) if zone else t


def time_parts(t: Column, zone: str | None = None, given: str | None = None) -> Column:
    """{h, m, s} of a timestamp, as `in_zone`."""
    t = in_zone(t, zone, given)
    return F.when(t.isNotNull(), F.struct(F.hour(t).alias("h"), F.minute(t).alias("m"), F.second(t).alias("s")))


def time_text(t: Column, pattern: str, zone: str | None = None, given: str | None = None) -> Column:
    return F.date_format(in_zone(t, zone, given), pattern)


def utc_date() -> Column:
    return date_parts(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def utc_time() -> Column:
    return time_parts(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def local_date() -> Column:
    return date_parts(F.current_timestamp())


def local_time() -> Column:
    return time_parts(F.current_timestamp())


def compare_date(a: Column, b: Column) -> Column:
    return F.signum(F.datediff(a, b)).cast("int")


def add_time(a: Column, b: Column) -> Column:
    """Sum of {sec, nsec} clocks with a carry at 10^9 nanoseconds."""
    n = a["nsec"] + b["nsec"]
    return F.struct((a["sec"] + b["sec"] + F.floor(n / NANOS)).cast("long").alias("sec"), F.pmod(n, F.lit(NANOS)).cast("long").alias("nsec"))


def sub_time(a: Column, b: Column) -> Column:
    n = a["nsec"] - b["nsec"]
    return F.struct((a["sec"] - b["sec"] + F.floor(n / NANOS)).cast("long").alias("sec"), F.pmod(n, F.lit(NANOS)).cast("long").alias("nsec"))


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def int_div(a: Column, b: Column) -> Column:
    """Quotient towards zero; an error for a zero divisor."""
    q = a.cast("double") / b
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise(F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long"))


def truncate(x: Column) -> Column:
    return x.cast("long")


def greatest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def hash_of(*c: Column) -> Column:
    return F.xxhash64(*c)


def seeded_int(n: int, seed: Column) -> Column:
    """A number from 0 to n - 1 that depends on the seed only."""
    return F.pmod(F.xxhash64(seed), F.lit(n))


def seeded_fraction(seed: Column) -> Column:
    return F.pmod(F.xxhash64(seed), F.lit(1 << 52)) / F.lit(float(1 << 52))


def seeded_word(length: int, seed: Column) -> Column:
    """A word of lower-case letters that depends on the seed only."""
    letters = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substr(F.lit(ASCII_LOWER), (F.pmod(F.xxhash64(seed, i), F.lit(26)) + 1).cast("int"), F.lit(1)))
    return F.array_join(letters, "")


def seeded_binomial(n: int, p: float, seed: Column) -> Column:
    """How many of n trials of probability p succeed; depends on the seed only."""
    trials = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.pmod(F.xxhash64(seed, i), F.lit(1 << 52)) / F.lit(float(1 << 52)) < p).cast("int"))
    return F.aggregate(trials, F.lit(0), lambda a, x: a + x) if n else F.lit(0)


def register(spark: SparkSession) -> None:
    """SQL names for what SQL lacks, as SQL functions, so they stay inside the JVM."""
    for name, args, body in (
        ("take_until", "s STRING, d STRING", "substring_index(s, d, 1)"),
        ("count_char", "s STRING, c STRING", "length(s) - length(replace(s, c, ''))"),
        ("slice_string", "s STRING, x INT, y INT", "substring(s, greatest(x, 0) + 1, greatest(y - greatest(x, 0), 0))"),
        ("strcomp", "a STRING, b STRING", "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END"),
        ("date_int", "d DATE", "year(d) * 10000 + month(d) * 100 + day(d)"),
        ("regex_match_int", "p STRING, s STRING", "CAST(s RLIKE concat('^(?:', p, ')\\\\z') AS INT)"),
    ):
        kind = "STRING" if name in ("take_until", "slice_string") else "INT"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
