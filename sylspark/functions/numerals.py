"""Number words, phone numbers, dates and times."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import resources as R

ONES = " emu bbiri ssatu nnya ttaano mukaaga musanvu munaana mwenda kkumi".split(" ")
_TENS = dict(zip(range(20, 100, 10), "abiri asatu ana ataano nkaaga nsanvu kinaana kyenda".split()))
_HUNDREDS = dict(zip(range(1, 10), "kikumi bibiri bisatu bina bitaano lukaaga lusanvu lunaana lwenda".split()))
_THOUSANDS = dict(zip(range(1, 10), ["lukumi", "nkumi bbiri", "nkumi ssatu", "nkumi nnya", "nkumi ttaano", "kakaaga", "kasanvu", "kanaana", "kenda"]))
#: Value, one of it, several of it.
_UNITS = [(10**21, "kasedde kamu", "busedde"), (10**18, "kafukunya kamu", "bufukunya"), (10**12, "kawumbi kamu", "buwumbi"), (10**6, "kakadde kamu", "bukadde"), (10**5, "kasiriivu kamu", "busiriivu"), (10**4, "mutwalo gumu", "mitwalo")]
#: Forms that agree, by noun class and number; numbers without one keep their own word.
AGREEMENT = {
    k: dict(zip((1, 2, 3, 4, 5, 10), forms.split()))
    for k, forms in {1: "omu babiri basatu bana bataano abakumi", 2: "gumu ebiri esatu ena etaano egikumi", 3: "limu abiri asatu ana ataano agakumi", 4: "kimu bibiri bisatu bina bitaano ebikumi", 5: "kamu bubiri busatu buna butaano obukumi", 6: "kumu", 7: "lumu"}.items()
}


def number_words(n: int, noun_class: int | None = None) -> str:
    """Words of an integer; its last number up to ten agrees with ``noun_class``, and counts of ten thousands and more with their unit's class."""
    if n < 0:
        return "minus " + number_words(-n, noun_class)
    if n == 0:
        return "zeero"
    if n <= 10:
        return AGREEMENT.get(noun_class, {}).get(n, ONES[n])
    if n == 11:
        return "kkumi n'emu"
    if n < 20:
        return "kkumi na " + number_words(n - 10, noun_class)
    if n == 500:
        return "tutaano"
    if n < 100:
        head, rest = _TENS[n - n % 10], n % 10
    elif n < 1000:
        head, rest = _HUNDREDS[n // 100], n % 100
    elif n < 10_000:
        head, rest = _THOUSANDS[n // 1000], n % 1000
    else:
        value, one, several = next(u for u in _UNITS if n >= u[0])
        k, rest = divmod(n, value)
        head = one if k == 1 else f"{several} {number_words(k, 2 if value == 10**4 else 5)}"
    return f"{head} mu {number_words(rest, noun_class)}" if rest else head


_VALUES = {w: k for k, w in enumerate(ONES) if w} | {w: v for v, w in _TENS.items()} | {w: 100 * k for k, w in _HUNDREDS.items()} | {w: 1000 * k for k, w in _THOUSANDS.items() if " " not in w} | {"zeero": 0, "tutaano": 500} | {w: n for k in (2, 5) for n, w in AGREEMENT[k].items()}
_MANY = {several: value for value, _, several in _UNITS} | {"nkumi": 1000, "bikumi": 100}
_ONE = {one.split()[0]: value for value, one, _ in _UNITS}


def words_number(text: str | None) -> int | None:
    """The number that words say, or None."""
    if not text or not text.strip():
        return None
    text = text.strip().lower()
    if text in _VALUES:
        return _VALUES[text]
    total, held = 0, 0
    # "mu" joins parts from large to small; inside a counted unit it joins the count's own parts
    parts = re.split(r"\s+mu\s+", text)
    for part in parts:
        value = 0
        found = re.fullmatch(r"kk?umi\s+(?:na\s+|n')(\w+)", part)
        tokens = part.split()
        if found:
            value = 10 + _VALUES.get(found[1], 0)
        elif len(tokens) >= 2 and tokens[0] in _MANY:
            value = _MANY[tokens[0]] * (words_number(" ".join(tokens[1:])) or 1)
        elif len(tokens) == 2 and tokens[0] in _ONE:
            value = _ONE[tokens[0]]
        else:
            value = sum(_VALUES.get(t, 0) for t in tokens)
        total += value
    return total + held or None


def number_words_column(n: Column) -> Column:
    """Words of a column of integers; meant for distinct values that are joined back."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else number_words(int(v)))

    return run(n)


def words_number_column(text: Column) -> Column:
    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return x.map(words_number).astype("Int64")

    return run(text)


def small_number_words(n: Column) -> Column:
    """Words of 0 to 999 as a lookup in a literal map, without Python."""
    table = F.create_map(*(F.lit(x) for k in range(1000) for x in (k, number_words(k))))
    return F.element_at(table, n.cast("int"))


def phone(raw: Column) -> Column:
    """Struct of country code, prefix and number; null if it isn't one."""
    digits = F.regexp_replace(F.regexp_replace(raw, r"[^0-9+]", ""), r"^\++", "")
    out = None
    for code, (p, n) in R.DIALLING.items():
        own = F.substring(digits, len(code) + 1, 99)
        cond = digits.startswith(code)
        then = F.when(F.char_length(own) == p + n, F.struct(F.lit(code).alias("country_code"), F.substring(own, 1, p).alias("prefix"), F.substring(own, p + 1, n).alias("number")))
        out = F.when(cond, then) if out is None else out.when(cond, then)
    own = F.substring(digits, 2, 99)
    return out.when(digits.startswith("0") & (F.char_length(own) == 9), F.struct(F.lit("256").alias("country_code"), F.substring(own, 1, 2).alias("prefix"), F.substring(own, 3, 7).alias("number")))


def operator(parsed: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in R.OPERATORS.items() for x in kv))
    return F.when(parsed["country_code"] == "256", F.try_element_at(table, parsed["prefix"]))


def phone_display(parsed: Column, raw: Column) -> Column:
    n = parsed["number"]
    return F.when(parsed.isNull(), raw).otherwise(F.concat(F.lit("+"), parsed["country_code"], F.lit(" "), parsed["prefix"], F.lit(" "), F.substring(n, 1, 3), F.lit(" "), F.substring(n, 4, 9)))


def phone_words(digits: str, style: str = "full") -> str:
    """Spoken digits: one by one, or in groups."""
    groups = {"full": list(digits), "grouped": [digits[:3], digits[3:]], "natural": [digits[:2], digits[2:5], digits[5:]]}[style]
    if style == "grouped":
        return ", ".join(number_words(int(g)) for g in groups if g)
    return (", " if style == "natural" else " ").join(" ".join(number_words(int(d)) for d in g) for g in groups if g)


def numeric_dates(text: Column) -> Column:
    """Array of (day, month, year, format) of dates of digits whose parts are in range."""
    out = F.array().cast("array<struct<day:int,month:int,year:int,format:string>>")
    for pattern, order, name in ((r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b", (1, 2, 3), "dmy"), (r"\b(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})\b", (3, 2, 1), "ymd")):
        parts = [F.transform(F.regexp_extract_all(text, F.lit(pattern), g), lambda x: x.cast("int")) for g in order]
        rows = F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("day", "month", "year")))), lambda r: F.struct(r["day"].alias("day"), r["month"].alias("month"), r["year"].alias("year"), F.lit(name).alias("format")))
        out = F.concat(out, F.filter(rows, lambda r: r["day"].between(1, 31) & r["month"].between(1, 12) & r["year"].between(1, 9999)))
    return out


def month_number(name: Column) -> Column:
    table = {n: k + 1 for names in (R.MONTHS_TRADITIONAL, R.MONTHS_ENGLISH, [R.modern_month(k) for k in range(1, 13)]) for k, n in enumerate(names)}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(name))


def day_number(name: Column) -> Column:
    table = {n: k + 1 for names in (R.DAYS_TRADITIONAL, R.DAYS_MODERN, R.DAYS_ENGLISH) for k, n in enumerate(names)}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(name))


def hour_24(hour: Column, part: Column) -> Column:
    """24-hour clock of a local hour (1 to 12) and a part of the day; null where they don't go together."""
    return (
        F.when((part == "okumakya") & ((hour == 12) | hour.between(1, 5)), hour % 12 + 6)
        .when((part == "ttuntu") & (hour == 6), F.lit(12))
        .when((part == "olweggulo") & hour.between(7, 11), hour % 12 + 6)
        .when((part == "akawungeezi") & (hour == 12), F.lit(18))
        .when((part == "ekiro") & hour.between(1, 5), hour + 18)
        .when((part == "ekiro") & hour.between(7, 11), hour - 6)
        .when((part == "ttumbi") & (hour == 6), F.lit(0))
    )


CURRENCIES = {"UGX": ("Ssiringi", r"(?:UGX|Shs\.?|=/=|=)"), "USD": ("Ddoola", r"\$"), "GBP": ("Pawundi", "£"), "EUR": ("Yuro", "€")}


def amounts(text: Column) -> Column:
    """Array of (currency, amount) of the sums of money in a text, by currency."""
    out = F.array().cast("array<struct<currency:string,amount:double>>")
    for code, (_, mark) in CURRENCIES.items():
        found = F.regexp_extract_all(text, F.lit(mark + r"\s*([\d,]+(?:\.\d{1,2})?)"), 1)
        out = F.concat(out, F.filter(F.transform(found, lambda x: F.struct(F.lit(code).alias("currency"), F.translate(x, ",", "").try_cast("double").alias("amount"))), lambda r: r["amount"].isNotNull()))
    return out


def money_words(amount: float, currency: str) -> str:
    """A sum in words; two to five agree, cents follow."""
    whole = int(amount)
    cents = round((amount - whole) * 100)
    count = {2: "zibiri", 3: "zisatu", 4: "zina", 5: "zitaano"}.get(whole) or number_words(whole)
    return f"{CURRENCIES[currency][0]} {count}" + (f" n'ennusu {number_words(cents)}" if cents > 0 else "")


def money_words_column(amount: Column, currency: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or k not in CURRENCIES else money_words(float(a), k) for a, k in zip(x, c)])

    return run(amount, currency)


_SHORT = {m[:3]: k + 1 for k, m in enumerate(R.MONTHS_ENGLISH)} | {"sept": 9} | {m: k + 1 for k, m in enumerate(R.MONTHS_ENGLISH)}


def english_dates(text: Column) -> Column:
    """Array of (day, month, year, format) of dates with an English month's name; the year can be missing."""
    table = F.create_map(*(F.lit(x) for kv in _SHORT.items() for x in kv))
    out = F.array().cast("array<struct<day:int,month:int,year:int,format:string>>")
    for pattern, (d, m, y), name in ((r"\b(\w+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})?\b", (2, 1, 3), "mdy"), (r"\b(\d{1,2})(?:st|nd|rd|th)?\s+(\w+)\s*(\d{4})?\b", (1, 2, 3), "dmy")):
        day, month, year = (F.regexp_extract_all(text, F.lit(pattern), k) for k in (d, m, y))
        rows = F.transform(F.arrays_zip(day.alias("d"), month.alias("m"), year.alias("y")), lambda r: F.struct(r["d"].cast("int").alias("day"), F.try_element_at(table, F.lower(r["m"])).alias("month"), F.nullif(r["y"], F.lit("")).cast("int").alias("year"), F.lit(name).alias("format")))
        out = F.concat(out, F.filter(rows, lambda r: r["month"].isNotNull() & r["day"].between(1, 31)))
    return out


def clock_times(text: Column) -> Column:
    """Array of (hour, minute, part) of local times in digits; the hour is of the 24-hour clock, null where it doesn't go with the part of the day."""
    parts = "okumakya|ttuntu|olweggulo|akawungeezi|ekiro|ttumbi"
    pattern = F.lit(rf"\b(\d{{1,2}}):(\d{{2}})(?:\s+(?:ey'|ez'|e')?({parts}))?(?=\s|$|[,.\n])")
    hour, minute, part = (F.regexp_extract_all(F.lower(text), pattern, k) for k in (1, 2, 3))
    return F.transform(F.arrays_zip(hour.alias("h"), minute.alias("m"), part.alias("p")), lambda r: F.struct(hour_24(r["h"].cast("int"), r["p"]).cast("int").alias("hour"), r["m"].cast("int").alias("minute"), F.nullif(r["p"], F.lit("")).alias("part")))
