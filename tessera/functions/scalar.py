"""Built-in scalar functions, as builders of Spark columns.

A builder gets the argument columns and their types.  NULL in gives NULL out
unless noted; wrong values are errors, as under ANSI mode.  Only Jaro-Winkler,
TO_CHAR of numbers and INITCAP's kind of word need more than expressions, and
only the first runs Python (in Arrow batches).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.lexer import AlgebraError

REGISTRY: dict[str, tuple[int, int, Callable]] = {}
ALIASES = {
    "UPPER": "UCASE", "LOWER": "LCASE", "LENGTH": "LEN", "CHAR_LENGTH": "LEN", "CHARACTER_LENGTH": "LEN", "CHAR": "CHR", "FLOOR": "INT", "CEILING": "CEIL", "SQRT": "SQR", "SIGN": "SGN", "RANDOM": "RAND", "REPLICATE": "REPEAT",
    "DATEFROMPARTS": "MAKE_DATE", "EOMONTH": "LAST_DAY", "TIMESTAMPADD": "DATEADD", "LN": "LOG", "ARRAY_LENGTH": "CARDINALITY", "SUBSTR": "SUBSTRING", "TRUNCATE": "TRUNC", "POW": "POWER",
}
#: Not the same value twice: an iteration's step may not use these.
VOLATILE = {"RAND"}


def _fn(name: str, least: int, most: int | None = None):
    def add(f):
        REGISTRY[name] = least, least if most is None else most, f
        return f

    return add


def build(name: str, args: list[Column], types: list[T.DataType | None]) -> Column:
    name = ALIASES.get(name, name)
    if name not in REGISTRY:
        raise AlgebraError(f"unknown function {name}")
    least, most, f = REGISTRY[name]
    if not least <= len(args) <= (most if most >= 0 else len(args)):
        raise AlgebraError(f"{name} takes {least}{'' if most == least else f' to {most}' if most >= 0 else ' or more'} arguments, not {len(args)}")
    return f(args, types)


def _simple(name: str, n: int, f: Callable):
    REGISTRY[name] = n, n, lambda a, t: f(*a)


def _checked(good: Column, value: Column, message: str) -> Column:
    return F.when(good, value).when(good.isNull(), None).otherwise(F.raise_error(F.lit(message)).cast("double"))


_DOUBLE = T.DoubleType()

# Conditional
_simple("IIF", 3, lambda c, a, b: F.when(c, a).when(c.isNull(), None).otherwise(b))
_simple("NULLIF", 2, F.nullif)


@_fn("NZ", 1, 2)
def _nz(a, t):
    if len(a) == 2:
        return F.coalesce(*a)
    return F.coalesce(a[0].cast("string"), F.lit("")) if not isinstance(t[0], T.StringType) else F.coalesce(a[0], F.lit(""))


@_fn("COALESCE", 1, -1)
def _coalesce(a, t):
    return F.coalesce(*a)


@_fn("SWITCH", 2, -1)
def _switch(a, t):
    out = F.when(a[0], a[1])
    for c, v in zip(a[2::2], a[3::2]):
        out = out.when(c, v)
    return out.otherwise(a[-1]) if len(a) % 2 else out


@_fn("CHOOSE", 2, -1)
def _choose(a, t):
    out = F.when(a[0] == 1, a[1])
    for i, v in enumerate(a[2:], 2):
        out = out.when(a[0] == i, v)
    return out


# Conversion
def plain(c: Column, t: T.DataType | None) -> Column:
    """The display form: decimals lose their trailing zeros, whole doubles
    their fraction."""
    s = c.cast("string")
    if isinstance(t, (T.DecimalType, T.DoubleType, T.FloatType)):
        return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return s


@_fn("CSTR", 1)
def _cstr(a, t):
    return F.when(a[0].isNull(), F.raise_error(F.lit("CStr of NULL")).cast("string")).otherwise(plain(a[0], t[0]))


@_fn("CINT", 1)
def _cint(a, t):
    if isinstance(t[0], T.BooleanType):
        return a[0].cast("bigint")
    return F.round(a[0].cast("decimal(38,10)")).cast("bigint")


@_fn("CDBL", 1)
def _cdbl(a, t):
    return a[0].cast("double")


@_fn("CBOOL", 1)
def _cbool(a, t):
    if not isinstance(t[0], T.StringType):
        return a[0].cast("boolean")
    s = F.lower(F.trim(a[0]))
    return F.when(s.isin("t", "true", "y", "yes", "on", "1"), True).when(s.isin("f", "false", "n", "no", "off", "0"), False).when(s.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), a[0])).cast("boolean"))


@_fn("FORMAT", 1, 2)
def _format(a, t):
    n = int(getattr(a[1], "_tessera_literal", -1)) if len(a) > 1 else 0
    if n < 0:
        raise AlgebraError("FORMAT takes a literal number of places")
    return F.format_number(F.round(a[0].cast("decimal(38,10)"), n), n)


_PATTERN = (("YYYY", "yyyy"), ("MONTH", "MMMM"), ("Month", "MMMM"), ("MON", "MMM"), ("Mon", "MMM"), ("MM", "MM"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("Day", "EEEE"), ("DY", "EEE"), ("Dy", "EEE"), ("AM", "a"), ("PM", "a"), ("Q", "Q"))


@_fn("TO_CHAR", 2)
def _to_char(a, t):
    text = getattr(a[1], "_tessera_literal", None)
    if isinstance(t[0], (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if text is None:
            raise AlgebraError("TO_CHAR takes a literal pattern")
        out, i = "", 0
        while i < len(text):
            for p, j in _PATTERN:
                if text.startswith(p, i):
                    out += j
                    i += len(p)
                    break
            else:
                out += f"'{text[i]}'" if text[i].isalpha() else text[i]
                i += 1
        return F.date_format(a[0], out)
    # PostgreSQL keeps a place for the sign unless FM stands first.
    if text is None:
        raise AlgebraError("TO_CHAR takes a literal pattern")
    fill = not text.upper().startswith("FM")
    body = text[2:] if not fill else text
    places = len(body.split(".")[1]) if "." in body else 0
    width = len(body) + 1
    s = F.format_number(F.abs(F.round(a[0].cast("decimal(38,10)"), places)), places)
    if "," not in body:
        s = F.replace(s, F.lit(","), F.lit(""))
    whole = body.split(".")[0].replace(",", "")
    if "0" in whole:
        s = F.lpad(s, len(body) - whole.index("0") if "," not in body else len(body), "0")
    signed = F.concat(F.when(a[0] < 0, "-").otherwise(""), s)
    return F.when(F.length(signed) > width, F.lit("#" * width)).otherwise(F.lpad(signed, width, " ") if fill else signed)


# Dates and times
_simple("NOW", 0, F.current_timestamp)
_simple("CURRENT_DATE", 0, F.current_date)
_simple("CURRENT_TIME", 0, lambda: F.date_format(F.current_timestamp(), "HH:mm:ss.SSSSSS"))
for _n, _f in {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DOY": F.dayofyear, "WEEK": F.weekofyear, "QUARTER": F.quarter, "LAST_DAY": F.last_day}.items():
    _simple(_n, 1, _f)
_simple("DOW", 1, lambda d: F.dayofweek(d) - 1)
_simple("ISODOW", 1, lambda d: F.weekday(d) + 1)
_simple("ISOYEAR", 1, lambda d: F.extract(F.lit("YEAROFWEEK"), d))
_simple("MAKE_DATE", 3, lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int")))
_simple("TIMEZONE", 2, lambda z, ts: F.from_utc_timestamp(ts, z))
_simple("FROM_TZ", 2, lambda ts, z: F.struct(F.to_utc_timestamp(ts, z).alias("at"), ((F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.to_utc_timestamp(ts, z))) / 1_000_000).cast("int").alias("offset_s")))
_simple("TO_DATE", 1, F.to_date)
_simple("TO_TIMESTAMP", 1, lambda s: F.to_timestamp(F.replace(s, F.lit("T"), F.lit(" "))))
_simple("TO_TIME", 1, lambda s: F.date_format(F.to_timestamp(F.concat(F.lit("1970-01-01 "), s)), "HH:mm:ss.SSSSSS"))


@_fn("TO_TIMESTAMPTZ", 1)
def _to_tz(a, t):
    mark = F.regexp_extract(a[0], r"([+-]\d{2}:?\d{2}|Z)$", 1)
    digits = F.regexp_replace(mark, "[^0-9]", "")
    seconds = F.when(F.length(digits) == 4, (F.substring(digits, 1, 2).cast("int") * 3600 + F.substring(digits, 3, 2).cast("int") * 60) * F.when(mark.startswith("-"), -1).otherwise(1)).otherwise(0)
    return F.when(a[0].isNotNull(), F.struct(F.to_timestamp(a[0]).alias("at"), seconds.cast("int").alias("offset_s")))


@_fn("EPOCH", 1)
def _epoch(a, t):
    if isinstance(t[0], T.DayTimeIntervalType):
        return _seconds(a[0])
    return F.unix_micros(a[0].cast("timestamp")).cast("decimal(38,6)") / 1_000_000


def _seconds(interval: Column) -> Column:
    """Seconds of a day-time interval, exactly."""
    e = lambda f: F.extract(F.lit(f), interval)
    return e("DAY").cast("decimal(38,6)") * 86_400 + e("HOUR") * 3600 + e("MINUTE") * 60 + e("SECOND")


def _whole(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")


def _per(interval: Column, n: int) -> Column:
    s = F.floor(_seconds(interval)).cast("bigint")
    return ((s - s % n) / n).cast("bigint")


_simple("SECONDS", 1, lambda i: _per(i, 1))
# Of whole seconds, in whole numbers: a decimal quotient may be rounded up to the next.
_simple("MINUTES", 1, lambda i: _per(i, 60))
_simple("DAYS", 1, lambda i: _per(i, 86_400))


@_fn("DATE_TRUNC", 2)
def _date_trunc(a, t):
    return F.date_trunc(_literal(a[0], "DATE_TRUNC"), a[1])


def _literal(c: Column, where: str) -> str:
    text = getattr(c, "_tessera_literal", None)
    if text is None:
        raise AlgebraError(f"{where} takes a literal unit")
    return str(text).lower().rstrip("s")


@_fn("DATEDIFF", 2, 3)
def _datediff(a, t):
    """Boundaries crossed, weeks beginning on Monday."""
    if len(a) == 2:
        return F.datediff(a[1], a[0]).cast("bigint")
    unit, x, y = _literal(a[0], "DATEDIFF"), a[1], a[2]
    if unit in ("year", "quarter", "month"):
        per = {"year": 1, "quarter": 4, "month": 12}[unit]
        part = {"year": lambda d: F.lit(0), "quarter": F.quarter, "month": F.month}[unit]
        return ((F.year(y) - F.year(x)) * per + part(y) - part(x)).cast("bigint")
    if unit == "week":
        return (F.datediff(F.date_trunc("week", y), F.date_trunc("week", x)) / 7).cast("bigint")
    if unit == "day":
        return F.datediff(y, x).cast("bigint")
    size = {"hour": 3600, "minute": 60, "second": 1}.get(unit)
    if size is None:
        raise AlgebraError(f"DATEDIFF knows no {unit}")
    at = lambda d: F.floor(F.unix_micros(d.cast("timestamp")) / (size * 1_000_000))
    return (at(y) - at(x)).cast("bigint")


def _keep_date(out: Column, t) -> Column:
    return out.cast("date") if isinstance(t, T.DateType) else out


@_fn("DATEADD", 3)
def _dateadd(a, t):
    unit, n = _literal(a[0], "DATEADD"), _whole(a[1]).cast("int")
    per = {"year": 12, "quarter": 3, "month": 1}.get(unit)
    ts = a[2].cast("timestamp")
    if per:
        return _keep_date(ts + F.make_ym_interval(F.lit(0), n * per), t[2])
    size = {"week": 604_800, "day": 86_400, "hour": 3600, "minute": 60, "second": 1}.get(unit)
    if size is None:
        raise AlgebraError(f"DATEADD knows no {unit}")
    return _keep_date(ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n.cast("bigint") * size).cast("decimal(18,6)")), t[2])


@_fn("ADD_MONTHS", 2)
def _add_months(a, t):
    moved = F.add_months(a[0].cast("date"), a[1].cast("int"))
    return F.when(a[0].cast("date") == F.last_day(a[0]), F.last_day(moved)).otherwise(moved)


@_fn("DATE_ADD", 2)
def _date_add(a, t):
    return _keep_date(a[0].cast("timestamp") + a[1], t[0])


@_fn("DATE_SUB", 2)
def _date_sub(a, t):
    return _keep_date(a[0].cast("timestamp") - a[1], t[0])


@_fn("AGE", 1, 2)
def _age(a, t):
    """struct<months, exact>: whole months, then the rest."""
    x, y = (F.current_date().cast("timestamp"), a[0]) if len(a) == 1 else a
    x, y = x.cast("timestamp"), y.cast("timestamp")
    m = _whole(F.months_between(x, y)).cast("int")
    # months_between passes over the time of day where the days agree
    at = y + F.make_ym_interval(F.lit(0), m)
    m = m - F.when((x >= y) & (at > x), 1).when((x < y) & (at < x), -1).otherwise(0)
    return F.struct(m.alias("months"), (x - (y + F.make_ym_interval(F.lit(0), m))).alias("exact"))


# Strings
_WS = r"[\s\u0085   -     　]"
_simple("TRIM", 1, lambda s: F.regexp_replace(s, f"^{_WS}+|{_WS}+$", ""))
_simple("LTRIM", 1, lambda s: F.regexp_replace(s, f"^{_WS}+", ""))
_simple("RTRIM", 1, lambda s: F.regexp_replace(s, f"{_WS}+$", ""))
for _n, _f in {"UCASE": F.upper, "LCASE": F.lower, "REVERSE": F.reverse, "MD5": F.md5, "SHA1": F.sha1}.items():
    _simple(_n, 1, lambda s, f=_f: f(s))
_simple("LEN", 1, lambda s: F.char_length(s).cast("bigint"))
_simple("SHA256", 1, lambda s: F.sha2(s, 256))
_simple("REPLACE", 3, lambda s, a, b: F.when(a == "", s).otherwise(F.replace(s, a, b)))
_simple("REPEAT", 2, lambda s, n: F.repeat(s, n.cast("int")))
_simple("STRPOS", 2, lambda s, x: F.position(x, s).cast("bigint"))
_simple("ASCII", 1, F.ascii)
_simple("SPLIT_PART", 3, lambda s, d, n: F.split_part(s, d, n.cast("int")))
_simple("SOUNDEX", 1, F.soundex)
_simple("LEVENSHTEIN", 2, lambda a, b: F.levenshtein(a, b).cast("bigint"))


def _text(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("string")


_simple("LEFT", 2, lambda s, n: F.when(n < 0, _text("LEFT of a negative length")).otherwise(F.left(s, n.cast("int"))))
_simple("RIGHT", 2, lambda s, n: F.when(n < 0, _text("RIGHT of a negative length")).otherwise(F.right(s, n.cast("int"))))
_simple("ASC", 1, lambda s: F.when(s == "", F.raise_error(F.lit("Asc of an empty string")).cast("int")).otherwise(F.ascii(s)))
_simple("CHR", 1, lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32"))


@_fn("SUBSTRING", 2, 3)
def _substring(a, t):
    """A start before 1 counts toward the length."""
    start = a[1].cast("int")
    if len(a) == 2:
        return F.substr(a[0], F.greatest(start, F.lit(1)))
    stop = start + F.greatest(a[2].cast("int"), F.lit(0))
    first = F.greatest(start, F.lit(1))
    return F.substr(a[0], first, F.greatest(stop - first, F.lit(0)))


@_fn("MID", 2, 3)
def _mid(a, t):
    first = F.greatest(a[1].cast("int"), F.lit(1))
    return F.substr(a[0], first, F.greatest(a[2].cast("int"), F.lit(0))) if len(a) == 3 else F.substr(a[0], first)


@_fn("INSTR", 2, 3)
def _instr(a, t):
    return F.position(a[1], a[0]).cast("bigint") if len(a) == 2 else F.position(a[2], a[1], a[0].cast("int")).cast("bigint")


@_fn("CHARINDEX", 2, 3)
def _charindex(a, t):
    return F.position(a[0], a[1], *([a[2].cast("int")] if len(a) == 3 else [])).cast("bigint")


@_fn("CONCAT", 1, -1)
def _concat(a, t):
    return F.concat(*[F.coalesce(plain(x, k), F.lit("")) for x, k in zip(a, t)])


@_fn("CONCAT_WS", 2, -1)
def _concat_ws(a, t):
    sep = a[0]
    return F.when(sep.isNotNull(), F.array_join(F.array_compact(F.array(*[plain(x, k) for x, k in zip(a[1:], t[1:])])), getattr(sep, "_tessera_literal", None))) if getattr(sep, "_tessera_literal", None) is not None else F.call_function("concat_ws", sep, *[plain(x, k) for x, k in zip(a[1:], t[1:])])


@_fn("LPAD", 2, 3)
def _lpad(a, t):
    return F.call_function("lpad", a[0], a[1].cast("int"), a[2] if len(a) == 3 else F.lit(" "))


@_fn("RPAD", 2, 3)
def _rpad(a, t):
    return F.call_function("rpad", a[0], a[1].cast("int"), a[2] if len(a) == 3 else F.lit(" "))


@_fn("INITCAP", 1)
def _initcap(a, t):
    words = F.regexp_extract_all(F.lower(a[0]), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), 0)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


@_fn("SHA2", 2)
def _sha2(a, t):
    bits = getattr(a[1], "_tessera_literal", None)
    if bits not in (0, 224, 256, 384, 512):
        raise AlgebraError("SHA2 takes 0, 224, 256, 384 or 512 bits")
    return F.sha2(a[0], int(bits))


def _digest(name: str, s: Column) -> Column:
    f = {"md5": F.md5, "sha1": F.sha1, "sha": F.sha1, "sha256": lambda x: F.sha2(x, 256), "sha2_256": lambda x: F.sha2(x, 256), "sha384": lambda x: F.sha2(x, 384), "sha512": lambda x: F.sha2(x, 512), "sha2_512": lambda x: F.sha2(x, 512)}.get(name.lower().replace("-", ""))
    if f is None:
        raise AlgebraError(f"unknown hash {name}")
    return f(s)


@_fn("HASHBYTES", 2)
def _hashbytes(a, t):
    return _digest(str(getattr(a[0], "_tessera_literal", "")), a[1])


@_fn("STANDARD_HASH", 1, 2)
def _standard_hash(a, t):
    return _digest(str(getattr(a[1], "_tessera_literal", "")) if len(a) == 2 else "sha1", a[0])


# Regular expressions: Java's dialect, found anywhere, dot matches newlines
@_fn("REGEXP_LIKE", 2, 3)
def _regexp_like(a, t):
    fold = "i" in str(getattr(a[2], "_tessera_literal", "")) if len(a) == 3 else False
    return F.regexp_like(a[0], F.concat(F.lit("(?si)" if fold else "(?s)"), a[1]))


@_fn("REGEXP_REPLACE", 3, 6)
def _regexp_replace(a, t):
    """The first match only, unless the flags say g; the positional form
    (start and, if given, occurrence 0) replaces all."""
    pattern = F.concat(F.lit("(?s)"), a[1])
    flags = getattr(a[3], "_tessera_literal", None) if len(a) > 3 else ""
    if isinstance(flags, str):
        if "i" in flags:
            pattern = F.concat(F.lit("(?si)"), a[1])
        if "g" in flags:
            return F.regexp_replace(a[0], pattern, a[2])
        # everything up to the end of the first match, put apart from the rest
        found = F.regexp_substr(a[0], pattern)
        at = F.position(found, a[0])
        head = F.substr(a[0], F.lit(1), at - 1)
        return F.when(found.isNull(), a[0]).otherwise(F.concat(head, F.regexp_replace(found, pattern, a[2]), F.substr(a[0], at + F.length(found))))
    start = a[3].cast("int")
    return F.concat(F.substr(a[0], F.lit(1), start - 1), F.regexp_replace(F.substr(a[0], start), pattern, a[2]))


@_fn("REGEXP_SUBSTR", 2, 4)
def _regexp_substr(a, t):
    s = F.substr(a[0], a[2].cast("int")) if len(a) > 2 else a[0]
    n = a[3].cast("int") if len(a) > 3 else F.lit(1)
    return F.get(F.regexp_extract_all(s, F.concat(F.lit("(?s)"), a[1]), 0), n - 1)


_simple("REGEXP_COUNT", 2, lambda s, p: F.regexp_count(s, F.concat(F.lit("(?s)"), p)).cast("bigint"))


# Similarity
@_fn("EDITSIMILARITY", 2)
def _edit(a, t):
    most = F.greatest(F.char_length(a[0]), F.char_length(a[1]))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a[0], a[1]) / most)


def trigrams(s: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(s), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


@_fn("TRIGRAM", 2)
def _trigram(a, t):
    x, y = trigrams(a[0]), trigrams(a[1])
    return F.when(a[0].isNotNull() & a[1].isNotNull(), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used) if u))) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro >= 0.7 else jaro


@_fn("JAROWINKLER", 2)
def _jaro(a, t):
    import pandas as pd

    def score(x, y):
        return pd.Series([None if p is None or q is None else jaro_winkler(p, q) for p, q in zip(x, y)], dtype="float64")

    score.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}  # how Spark tells the kind
    return F.pandas_udf(score, "double")(*a)


# JSON
_simple("JSON_VALUE", 2, lambda d, p: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(d), _path(p), "variant")).rlike("^(OBJECT|ARRAY|VOID)"), None).otherwise(F.call_function("get_json_object", d, p)))
_simple("JSON_QUERY", 2, lambda d, p: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(d), _path(p), "variant")).rlike("^(OBJECT|ARRAY)"), F.call_function("get_json_object", d, p)))
_simple("JSON_EXTRACT", 2, lambda d, p: F.try_variant_get(F.try_parse_json(d), _path(p), "variant"))


def _path(p: Column) -> str:
    text = getattr(p, "_tessera_literal", None)
    if text is None:
        raise AlgebraError("a JSON path is a literal")
    return text


# Mathematics
_simple("ABS", 1, F.abs)
_simple("INT", 1, F.floor)
_simple("CEIL", 1, F.ceil)
_simple("FIX", 1, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
_simple("SGN", 1, lambda x: F.signum(x).cast("int"))
_simple("SQR", 1, lambda x: _checked(x >= 0, F.sqrt(x), "Sqr of a negative number"))
_simple("LOG10", 1, lambda x: _checked(x > 0, F.log10(x), "Log10 of a number not above zero"))
_simple("EXP", 1, F.exp)
for _n, _f in {"SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ATN": F.atan, "DEGREES": F.degrees, "RADIANS": F.radians}.items():
    _simple(_n, 1, lambda x, f=_f: f(x))
_simple("ASIN", 1, lambda x: _checked(F.abs(x) <= 1, F.asin(x), "Asin outside -1 to 1"))
_simple("ACOS", 1, lambda x: _checked(F.abs(x) <= 1, F.acos(x), "Acos outside -1 to 1"))
_simple("ATAN2", 2, lambda y, x: F.atan2(y, x))
_simple("PI", 0, F.pi)
_simple("MOD", 2, lambda a, b: a % b)
_simple("RAND", 0, F.rand)


@_fn("ROUND", 1, 2)
def _round(a, t):
    n = a[1] if len(a) == 2 else F.lit(0)
    return F.round(a[0], n)


@_fn("TRUNC", 1, 2)
def _trunc(a, t):
    if len(a) == 1:
        return _whole(a[0])
    scale = F.pow(F.lit(10.0), a[1].cast("double"))
    x = a[0].cast("double") * scale
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)) / scale


@_fn("LOG", 1, 2)
def _log(a, t):
    x = a[-1]
    if len(a) == 1:
        return _checked(x > 0, F.ln(x), "Log of a number not above zero")
    return _checked((x > 0) & (a[0] > 0), F.ln(x) / F.ln(a[0]), "Log of a number not above zero")


@_fn("POWER", 2)
def _power(a, t):
    return F.pow(a[0], a[1])


# Nested values, order, type tests
_simple("ENTRIES", 1, lambda x: F.map_entries(F.from_json(F.to_json(x), "map<string,string>")))
_simple("CARDINALITY", 1, lambda x: F.cardinality(x).cast("bigint"))


@_fn("ARRAY_TO_STRING", 2, 3)
def _array_to_string(a, t):
    return F.call_function("array_join", a[0].cast("array<string>"), a[1], *a[2:])


@_fn("LEAST", 2, -1)
def _least(a, t):
    return F.when(~_any_null(a), F.least(*a))


@_fn("GREATEST", 2, -1)
def _greatest(a, t):
    return F.when(~_any_null(a), F.greatest(*a))


def _any_null(a: list[Column]) -> Column:
    out = a[0].isNull()
    for x in a[1:]:
        out = out | x.isNull()
    return out


_simple("ISNULL", 1, lambda x: x.isNull())


@_fn("ISNUMERIC", 1)
def _isnumeric(a, t):
    if not isinstance(t[0], T.StringType):
        return a[0].isNotNull() if isinstance(t[0], T.NumericType) else F.lit(False)
    return F.coalesce(a[0].rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), F.lit(False))


_CATEGORIES = {
    "conditional": "IIF NZ COALESCE NULLIF SWITCH CHOOSE",
    "conversion": "CSTR CINT CDBL CBOOL TO_CHAR FORMAT",
    "json": "JSON_VALUE JSON_QUERY JSON_EXTRACT",
    "math": "ABS INT FIX ROUND CEIL SGN SQR LOG LOG10 EXP SIN COS TAN ATN ASIN ACOS ATAN2 DEGREES RADIANS PI POWER MOD RAND TRUNC",
    "nested": "ENTRIES ARRAY_TO_STRING CARDINALITY",
    "ordering": "LEAST GREATEST",
    "similarity": "LEVENSHTEIN EDITSIMILARITY JAROWINKLER TRIGRAM SOUNDEX",
    "typecheck": "ISNULL ISNUMERIC",
    "datetime": "NOW CURRENT_DATE CURRENT_TIME YEAR MONTH DAY HOUR MINUTE SECOND DOW ISODOW DOY WEEK ISOYEAR QUARTER EPOCH TIMEZONE FROM_TZ MAKE_DATE LAST_DAY DATEDIFF DATE_TRUNC DATEADD ADD_MONTHS DATE_ADD DATE_SUB AGE MINUTES SECONDS DAYS TO_DATE TO_TIMESTAMP TO_TIME TO_TIMESTAMPTZ",
}


def category(name: str) -> str:
    """The family that a function is listed under."""
    return next((k for k, names in _CATEGORIES.items() if name in names.split()), "string")
