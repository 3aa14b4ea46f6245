"""Queries over lines, characters, numbers, dates, phones and languages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import numerals as N
from ..functions import resources as R
from ..functions import text as T
from .catalogue import query, table

LINES_SQL = r"SELECT doc_id, line, CAST(line_no - 1 AS INTEGER) AS line_no FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line, unnest(range(1, len(regexp_split_to_array(text, '\r\n|\n|\r')) + 1)) AS line_no FROM documents) WHERE line <> ''"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in r) + ")" for r in rows)


@query(LINES_SQL)
def line_scan(spark, d):
    return T.lines(table(spark, d, "documents"))


@query(rf"SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '[#;][^\n]*', '', 'g'), '[ \t\r\n\f\x0B]+$', '') AS line FROM ({LINES_SQL})")
def clean_lines(spark, d):
    return T.lines(table(spark, d, "documents")).withColumn("line", T.clean_line(F.col("line")))


@query("SELECT doc_id, n FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 100000")
def prefix_bytes_scan(spark, d):
    """Rows until their bytes reach a limit, the crossing one kept: running totals of blocks first, then inside the blocks that matter."""
    x = table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"), F.floor(F.col("doc_id") / 4096).alias("block"))
    # one row per 4096 documents is summed in order
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = x.groupBy("block").agg(F.sum("n").alias("s")).select("block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base")).where("base < 100000")
    inside = Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    y = x.join(F.broadcast(blocks), "block").withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return y.where("before < 100000").select("doc_id", "n")


@query(r"SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\p{L}\p{N}_'']+')) AS BIGINT) AS n_words FROM pages")
def html_text_words(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(T.words(F.regexp_replace("html", "<[^>]*>", " "))).cast("long").alias("n_words"))


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, {q(p)})) AS BIGINT) AS n_{k}" for k, p in T.CLASSES.items()) + " FROM documents")
def char_classes(spark, d):
    return table(spark, d, "documents").select("doc_id", *T.char_counts(F.col("text")))


@query(r"SELECT doc_id, regexp_matches(text, '[\x{0370}-\x{03FF}\x{0400}-\x{04FF}]') AS odd FROM documents")
def confusable_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", T.confusable(F.col("text")).alias("odd"))


@query("SELECT doc_id, md5(translate(text, 'оаекмнрстухОАЕКМНРСТУХáéíóúàèìòùâêîôû', 'oaekmhpctyxOAEKMHPCTYXaeiouaeiouaeiou')) AS folded FROM documents")
def ascii_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query("SELECT event_id, CAST(greatest(-32768, least(32767, floor(value * 256.0 + 0.5))) AS INTEGER) AS q FROM events")
def q88_quantise(spark, d):
    return table(spark, d, "events").select("event_id", T.quantise(F.col("value")).alias("q"))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(65535, floor((log2(l_extendedprice) + 32) * 1024))) AS INTEGER) AS q FROM lineitem")
def log_quantise(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.log_quantise(F.col("l_extendedprice")).alias("q"))


@query()
def grapheme_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.graphemes(F.col("text"))).alias("n_graphemes"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_points FROM documents")
def utf8_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.char_length("text").cast("long").alias("n_points"))


NUMBERS_SQL = f"WITH w(n, words) AS (VALUES {values((k, N.number_words(k)) for k in range(1000))})"


@query(NUMBERS_SQL + " SELECT p_partkey, p_size, words FROM part JOIN w ON w.n = p_size")
def number_words(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", N.small_number_words(F.col("p_size")).alias("words"))


@query()
def large_number_words(spark, d):
    """Words of the distinct prices, joined back, so that the conversion sees each number once."""
    x = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return x.join(x.select("cents").distinct().withColumn("words", N.number_words_column(F.col("cents"))), "cents")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n FROM lineitem")
def number_round_trip(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n"))
    back = x.select("n").distinct().withColumn("m", N.words_number_column(N.number_words_column(F.col("n"))))
    return x.join(F.broadcast(back), "n").select("l_orderkey", "l_linenumber", F.col("m").alias("n"))  # distinct quantities: 50


@query("WITH a(n, noun_class, form) AS (VALUES (1, 1, 'omu'), (1, 2, 'gumu'), (1, 3, 'limu'), (1, 4, 'kimu'), (1, 5, 'kamu'), (1, 6, 'kumu'), (1, 7, 'lumu'), (2, 1, 'babiri'), (2, 2, 'ebiri'), (2, 3, 'abiri'), (2, 4, 'bibiri'), (2, 5, 'bubiri'), (3, 1, 'basatu'), (3, 2, 'esatu'), (3, 3, 'asatu'), (3, 4, 'bisatu'), (3, 5, 'busatu'), (4, 1, 'bana'), (4, 2, 'ena'), (4, 3, 'ana'), (4, 4, 'bina'), (4, 5, 'buna'), (5, 1, 'bataano'), (5, 2, 'etaano'), (5, 3, 'ataano'), (5, 4, 'bitaano'), (5, 5, 'butaano')) SELECT l_orderkey, l_linenumber, form FROM lineitem JOIN a ON a.n = l_linenumber AND a.noun_class = l_suppkey % 8 + 1")
def agreement_forms(spark, d):
    a = spark.createDataFrame([(c, k, f) for c, fs in N.AGREEMENT.items() for k, f in fs.items()], "noun_class int, n int, form string")
    x = table(spark, d, "lineitem").withColumn("noun_class", (F.col("l_suppkey") % 8 + 1).cast("int"))
    return x.join(F.broadcast(a), (F.col("n") == F.col("l_linenumber")) & (x["noun_class"] == a["noun_class"])).select("l_orderkey", "l_linenumber", "form")


RAW_PHONE = "CASE c_custkey % 4 WHEN 0 THEN '0' || lpad(CAST(700000000 + c_custkey * 7919 % 99999999 AS VARCHAR), 9, '0') WHEN 1 THEN '+254 7' || lpad(CAST(c_custkey AS VARCHAR), 8, '2') WHEN 2 THEN '255-' || CAST(100000000 + c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END"
PHONE_SQL = f"""WITH r AS (SELECT c_custkey, {RAW_PHONE} AS raw FROM customer), d AS (SELECT *, regexp_replace(regexp_replace(raw, '[^0-9+]', '', 'g'), '^\\++', '') AS x FROM r),
p AS (SELECT *, CASE WHEN x LIKE '256%' THEN '256' WHEN x LIKE '254%' THEN '254' WHEN x LIKE '255%' THEN '255' WHEN x LIKE '0%' THEN '256' END AS cc, CASE WHEN x LIKE '256%' OR x LIKE '254%' OR x LIKE '255%' THEN substr(x, 4) ELSE substr(x, 2) END AS nat FROM d),
o AS (SELECT c_custkey, raw, CASE WHEN length(nat) = 9 THEN cc END AS country_code, CASE WHEN length(nat) = 9 AND cc IS NOT NULL THEN substr(nat, 1, CASE cc WHEN '254' THEN 3 ELSE 2 END) END AS prefix,
  CASE WHEN length(nat) = 9 AND cc IS NOT NULL THEN substr(nat, CASE cc WHEN '254' THEN 4 ELSE 3 END) END AS number FROM p)"""


def _phones(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr(RAW_PHONE.replace("VARCHAR", "STRING")).alias("raw")).withColumn("p", N.phone(F.col("raw")))


@query(PHONE_SQL + " SELECT c_custkey, country_code, prefix, number FROM o")
def phone_parse(spark, d):
    return _phones(spark, d).select("c_custkey", "p.*")


@query(PHONE_SQL + f", ops(prefix, operator) AS (VALUES {values(R.OPERATORS.items())}) SELECT c_custkey, operator, CASE WHEN country_code IS NULL THEN raw ELSE '+' || country_code || ' ' || o.prefix || ' ' || substr(number, 1, 3) || ' ' || substr(number, 4) END AS display FROM o LEFT JOIN ops ON o.prefix = ops.prefix AND country_code = '256'")
def phone_operator(spark, d):
    return _phones(spark, d).select("c_custkey", N.operator(F.col("p")).alias("operator"), N.phone_display(F.col("p"), F.col("raw")).alias("display"))


DATE_TEXT = "CASE o_orderkey % 3 WHEN 0 THEN {dmy} WHEN 1 THEN {ymd} ELSE '45/77/2020' END"


@query("SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year, CASE o_orderkey % 3 WHEN 0 THEN 'dmy' ELSE 'ymd' END AS format FROM orders WHERE o_orderkey % 3 <> 2")
def numeric_dates(spark, d):
    """Dates written in texts in two orders, or as nonsense, read back."""
    t = F.expr(DATE_TEXT.format(dmy="date_format(o_orderdate, 'd/M/yyyy')", ymd="date_format(o_orderdate, 'yyyy-MM-dd')"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(N.numeric_dates(F.concat(F.lit("on "), t, F.lit(" it was")))).alias("x")).select("o_orderkey", "x.*")


MONTHS = [(k, n) for k in range(1, 13) for n in (R.MONTHS_TRADITIONAL[k - 1], R.modern_month(k), R.MONTHS_ENGLISH[k - 1])]


@query(f"WITH m(k, name) AS (VALUES {values((k, R.MONTHS_TRADITIONAL[k - 1]) for k in range(1, 13))}) SELECT o_orderkey, name, CAST(k AS INTEGER) AS month FROM orders JOIN m ON m.k = month(o_orderdate)")
def month_names(spark, d):
    name = F.element_at(F.array(*(F.lit(n) for n in R.MONTHS_TRADITIONAL)), F.month("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", name.alias("name")).withColumn("month", N.month_number(F.col("name")))


@query(f"WITH m(k, name) AS (VALUES {values((k, R.modern_month(k)) for k in range(1, 13))}) SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(k AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders JOIN m ON m.k = month(o_orderdate)")
def mixed_dates(spark, d):
    """A day in digits beside a month's name, either first, and a year."""
    name = F.element_at(F.array(*(F.lit(R.modern_month(k)) for k in range(1, 13))), F.month("o_orderdate"))
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    t = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(" ", day, name, year)).otherwise(F.concat(name, F.lit(" "), day, F.lit(", "), year))
    x = table(spark, d, "orders").select("o_orderkey", t.alias("t"))
    return x.select("o_orderkey", F.regexp_extract("t", r"\b(\d{1,2})\b", 1).cast("int").alias("day"), N.month_number(F.regexp_extract("t", r"(\p{L}+)", 1)).alias("month"), F.regexp_extract("t", r"(\d{4})", 1).cast("int").alias("year"))


@query("SELECT day, month, year, confidence, n FROM (SELECT CAST(day(o_orderdate) AS INTEGER) AS day, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year, max(CASE WHEN o_orderkey % 3 = 0 THEN 0.95 WHEN o_orderkey % 3 = 1 THEN 0.92 ELSE 0.85 END)::DOUBLE AS confidence, count(*) AS n FROM orders GROUP BY ALL)")
def date_dedupe(spark, d):
    c = F.when(F.col("o_orderkey") % 3 == 0, 0.95).when(F.col("o_orderkey") % 3 == 1, 0.92).otherwise(0.85)
    return table(spark, d, "orders").groupBy(F.dayofmonth("o_orderdate").alias("day"), F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year")).agg(F.max(c).alias("confidence"), F.count("*").alias("n"))


PARTS = "okumakya ttuntu olweggulo akawungeezi ekiro ttumbi".split()


@query(f"""WITH p(k, part) AS (VALUES {values(enumerate(PARTS))}), x AS (SELECT event_id, CAST(event_id % 12 + 1 AS INTEGER) AS h, part FROM events JOIN p ON p.k = event_id % 6)
SELECT event_id, h, part, CAST(CASE WHEN part = 'okumakya' AND (h = 12 OR h <= 5) THEN h % 12 + 6 WHEN part = 'ttuntu' AND h = 6 THEN 12 WHEN part = 'olweggulo' AND h BETWEEN 7 AND 11 THEN h + 6 WHEN part = 'akawungeezi' AND h = 12 THEN 18
WHEN part = 'ekiro' AND h <= 5 THEN h + 18 WHEN part = 'ekiro' AND h BETWEEN 7 AND 11 THEN h - 6 WHEN part = 'ttumbi' AND h = 6 THEN 0 END AS INTEGER) AS hour FROM x""")
def local_hour_24(spark, d):
    part = F.element_at(F.array(*(F.lit(p) for p in PARTS)), (F.col("event_id") % 6 + 1).cast("int"))
    x = table(spark, d, "events").select("event_id", (F.col("event_id") % 12 + 1).cast("int").alias("h"), part.alias("part"))
    return x.withColumn("hour", N.hour_24(F.col("h"), F.col("part")).cast("int"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'UGX' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'EUR' END AS currency, CAST(floor(o_totalprice) + floor(o_totalprice * 100) % 100 / 100 AS DOUBLE) AS amount FROM orders")
def currency_amounts(spark, d):
    """Sums of money written into texts, with thousands parted, read back."""
    cents = F.floor(F.col("o_totalprice") * 100) % 100
    mark = F.element_at(F.array(*(F.lit(x) for x in ("Shs. ", "$", "£ ", "€"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    t = F.concat(F.lit("paid "), mark, F.format_number(F.floor("o_totalprice"), 0), F.lit("."), F.lpad(cents.cast("string"), 2, "0"), F.lit(" in all"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(N.amounts(t)).alias("x")).select("o_orderkey", "x.*")


@query()
def currency_words(spark, d):
    """The same sums in words, each distinct one said once."""
    x = currency_amounts(spark, d)
    said = x.select("currency", "amount").distinct().withColumn("words", N.money_words_column(F.col("amount"), F.col("currency")))
    return x.join(said, ["currency", "amount"])


@query("SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year, CASE o_orderkey % 2 WHEN 0 THEN 'mdy' ELSE 'dmy' END AS format FROM orders")
def english_dates(spark, d):
    """Dates with months' names, the month or the day first, read back."""
    month = F.element_at(F.array(*(F.lit(m.capitalize()) for m in R.MONTHS_ENGLISH)), F.month("o_orderdate"))
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    t = F.when(F.col("o_orderkey") % 2 == 0, F.concat(month, F.lit(" "), day, F.lit(", "), year)).otherwise(F.concat(day, F.lit("th "), F.substring(month, 1, 3), F.lit(" "), year))
    return table(spark, d, "orders").select("o_orderkey", F.explode(N.english_dates(F.concat(F.lit("(on) "), t, F.lit(".")))).alias("x")).select("o_orderkey", "x.*")


@query(f"""WITH p(k, part) AS (VALUES {values(enumerate(PARTS))}), x AS (SELECT event_id, CAST(event_id % 12 + 1 AS INTEGER) AS h, CAST(event_id % 60 AS INTEGER) AS minute, part FROM events JOIN p ON p.k = event_id % 6)
SELECT event_id, part, minute, CAST(CASE WHEN part = 'okumakya' AND (h = 12 OR h <= 5) THEN h % 12 + 6 WHEN part = 'ttuntu' AND h = 6 THEN 12 WHEN part = 'olweggulo' AND h BETWEEN 7 AND 11 THEN h + 6 WHEN part = 'akawungeezi' AND h = 12 THEN 18
WHEN part = 'ekiro' AND h <= 5 THEN h + 18 WHEN part = 'ekiro' AND h BETWEEN 7 AND 11 THEN h - 6 WHEN part = 'ttumbi' AND h = 6 THEN 0 END AS INTEGER) AS hour FROM x""")
def clock_times(spark, d):
    """Local times written into texts, read back on the 24-hour clock."""
    part = F.element_at(F.array(*(F.lit(p) for p in PARTS)), (F.col("event_id") % 6 + 1).cast("int"))
    t = F.concat(F.lit("at "), (F.col("event_id") % 12 + 1).cast("string"), F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(" ey'"), part, F.lit(", then"))
    return table(spark, d, "events").select("event_id", F.explode(N.clock_times(t)).alias("x")).select("event_id", "x.part", "x.minute", "x.hour")


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_HITS = ", ".join(
    "(len(list_filter(w, lambda x: x IN (" + ", ".join(q(x) for x in listed.split()) + f")))" + (f" + len(list_filter(w, lambda x: regexp_matches(x, '^(?:{starts.replace(' ', '|')}).')))" if starts else "") + f")::BIGINT AS {k}" for k, (starts, listed) in R.LANGUAGE_HITS.items()
)
LID_SQL = f"WITH t AS (SELECT doc_id, text, {_TOKENS} AS w FROM documents), h AS (SELECT doc_id, text, {_HITS} FROM t), s AS (SELECT *, lg + en + sw AS total FROM h), b AS (SELECT *, CASE WHEN total = 0 THEN 'unknown' WHEN lg >= en AND lg >= sw THEN 'lg' WHEN en >= sw THEN 'en' ELSE 'sw' END AS lang, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE greatest(lg, en, sw) / total::DOUBLE END AS confidence FROM s)"


def _languages(spark, d):
    hits = L.language_hits(F.col("text"))
    x = table(spark, d, "documents").select("doc_id", "text", *(c.alias(k) for k, c in hits.items())).withColumn("total", F.col("lg") + F.col("en") + F.col("sw"))
    lang = F.when(F.col("total") == 0, "unknown").when((F.col("lg") >= F.col("en")) & (F.col("lg") >= F.col("sw")), "lg").when(F.col("en") >= F.col("sw"), "en").otherwise("sw")
    return x.withColumn("lang", lang).withColumn("confidence", F.when(F.col("total") == 0, 0.0).otherwise(F.greatest("lg", "en", "sw") / F.col("total")))


@query(LID_SQL + " SELECT doc_id, lg, en, sw, lang, round(confidence, 6) AS confidence FROM b")
def lid_scores(spark, d):
    return _languages(spark, d).select("doc_id", "lg", "en", "sw", "lang", F.round("confidence", 6).alias("confidence"))


_SWITCH = "((lg > 0.25 * total)::INT + (en > 0.25 * total)::INT + (sw > 0.25 * total)::INT) > 1"


@query(LID_SQL + f" SELECT doc_id, {_SWITCH} AS switched, CASE WHEN {_SWITCH} THEN 'Code-switching detected' WHEN confidence < 0.7 THEN 'Low confidence' ELSE '' END AS reason FROM b")
def code_switch(spark, d):
    x = _languages(spark, d)
    many = sum(((F.col(k) > 0.25 * F.col("total")).cast("int") for k in ("lg", "en", "sw")), F.lit(0)) > 1
    x = x.withColumn("switched", many)
    return x.select("doc_id", "switched", F.when(F.col("switched"), "Code-switching detected").when(F.col("confidence") < 0.7, "Low confidence").otherwise("").alias("reason"))


@query(LID_SQL + f" SELECT CASE WHEN {_SWITCH} THEN 'code_switched' WHEN lang = 'lg' AND confidence >= 0.7 THEN 'accepted' WHEN confidence < 0.7 THEN 'low_confidence' ELSE 'wrong_language' END AS bucket, count(*) AS n FROM b GROUP BY 1")
def lid_buckets(spark, d):
    x = _languages(spark, d)
    many = sum(((F.col(k) > 0.25 * F.col("total")).cast("int") for k in ("lg", "en", "sw")), F.lit(0)) > 1
    b = F.when(many, "code_switched").when((F.col("lang") == "lg") & (F.col("confidence") >= 0.7), "accepted").when(F.col("confidence") < 0.7, "low_confidence").otherwise("wrong_language")
    return x.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


_IN = {k: "(" + ", ".join(q(w) for w in sorted(ws)) + ")" for k, ws in (("f", R.FORMAL), ("c", R.COLLOQUIAL))}
REGISTER_SQL = rf"SELECT doc_id, CAST(len(list_filter(w, lambda x: x IN {_IN['f']})) - len(list_filter(w, lambda x: x IN {_IN['c']})) - least(5, length(regexp_replace(text, '[^!?]', '', 'g'))) AS BIGINT) AS rating, CAST(len(w) AS BIGINT) AS n_words FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+') AS w FROM documents)"


def _register(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text", T.words(F.lower("text")).alias("w"))
    return x.select("doc_id", L.register(F.col("w"), F.col("text")).alias("rating"), F.size("w").cast("long").alias("n_words"))


@query(REGISTER_SQL)
def register_rating(spark, d):
    return _register(spark, d)


@query(f"SELECT doc_id, rating, n_words FROM (SELECT *, coalesce(sum(n_words) OVER (ORDER BY rating DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({REGISTER_SQL}) WHERE rating >= 0) WHERE before < 50000")
def register_take(spark, d):
    """Most formal first until the words suffice: totals by rating and block, so that only what crosses is put in order."""
    x = _register(spark, d).where("rating >= 0").withColumn("block", F.floor(F.col("doc_id") / 4096))
    before = Window.orderBy(F.desc("rating"), "block").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy("rating", "block").agg(F.sum("n_words").alias("s")).select("rating", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base")).where("base < 50000")
    inside = Window.partitionBy("rating", "block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    y = x.join(base, ["rating", "block"]).withColumn("before", F.col("base") + F.coalesce(F.sum("n_words").over(inside), F.lit(0)))
    return y.where("before < 50000").select("doc_id", "rating", "n_words")


#: Words of either side of a register split.
TARGET = 500_000


def _side(x, formal: bool, target: int):
    """Rows from the most formal (or most colloquial) to the neutral ones until there are ``target`` words."""
    sign = F.col("rating") if formal else -F.col("rating")
    x = x.withColumn("r", sign).where("r >= 0").withColumn("block", F.floor(F.col("doc_id") / 4096))
    before = Window.orderBy(F.desc("r"), "block").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy("r", "block").agg(F.sum("n_words").alias("s")).select("r", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base")).where(F.col("base") < target)
    inside = Window.partitionBy("r", "block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    y = x.join(base, ["r", "block"]).withColumn("before", F.col("base") + F.coalesce(F.sum("n_words").over(inside), F.lit(0)))
    return y.where(F.col("before") < target).select(F.lit("formal" if formal else "colloquial").alias("side"), "doc_id", "rating", "n_words")


def split_by_register(rated, target: int = TARGET):
    """``side, doc_id, rating, n_words``: both sides, each filled up from neutral rows, which can be in both."""
    return _side(rated, True, target).union(_side(rated, False, target))


_SIDE = "SELECT '{}' AS side, doc_id, rating, n_words FROM (SELECT *, coalesce(sum(n_words) OVER (ORDER BY {} DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (" + REGISTER_SQL.replace("{", "{{").replace("}", "}}") + ") WHERE {} >= 0) WHERE before < 500000"


@query(_SIDE.format("formal", "rating", "rating") + " UNION ALL " + _SIDE.format("colloquial", "-rating", "-rating"))
def register_split(spark, d):
    return split_by_register(_register(spark, d))
