"""Queries over word statistics, affixes, stems, sound rules, and similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import resources as R
from ..functions import text as T
from ..operators import morphology as M
from ..operators import similarity as S
from .catalogue import query, table
from .scalars import q, values

W = r"wr AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS w0 FROM documents), w AS (SELECT replace(w0, '''', '') AS word, count(*) AS freq FROM wr WHERE length(replace(w0, '''', '')) >= 3 GROUP BY 1)"


def _words(spark, d, least=1):
    return M.word_counts(table(spark, d, "documents"), least)


@query(f"WITH {W} SELECT word, freq FROM w")
def word_freq(spark, d):
    return _words(spark, d)


@query(f"WITH {W} SELECT word, freq FROM w WHERE freq > 20")
def frequent_words(spark, d):
    return _words(spark, d).where("freq > 20")


CUTS = f"{W}, f AS (SELECT * FROM w WHERE freq >= 5), k AS (SELECT word, freq, unnest(range(1, least(length(word) - 1, 5) + 1)) AS k FROM f)"
AFFIX = f"{CUTS}, a AS (SELECT 'prefix' AS side, left(word, k) AS affix, substr(word, k + 1) AS rest, freq FROM k UNION ALL SELECT 'suffix', right(word, k), left(word, length(word) - k), freq FROM k)"


@query(f"WITH {AFFIX} SELECT side, affix, sum(freq)::BIGINT AS freq, count(*) AS types FROM a GROUP BY side, affix")
def affix_counts(spark, d):
    return M.affix_counts(_words(spark, d, 5))


@query(f"WITH {AFFIX.replace('- 1, 5)', '- 1, 3)')}, x AS (SELECT affix, rest, sum(freq) AS n FROM a WHERE side = 'prefix' GROUP BY ALL), y AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY affix) AS na, sum(n) OVER (PARTITION BY rest) AS nb FROM x) SELECT affix, rest, n::BIGINT AS n, round(greatest(log2((n / t) / ((na / t) * (nb / t) + 1e-9)), 0), 6) AS pmi FROM y")
def pmi_prefix(spark, d):
    return M.pmi(_words(spark, d, 5)).withColumn("pmi", F.round("pmi", 6))


@query(f"WITH {CUTS.replace('- 1, 5)', '- 1, 6)')}, x AS (SELECT right(word, k) AS suffix, substr(word, length(word) - k, 1) AS b, freq FROM k) SELECT suffix, count(DISTINCT b) AS letters, sum(freq)::BIGINT AS freq FROM x GROUP BY suffix HAVING count(DISTINCT b) >= 2 AND sum(freq) >= 2")
def suffix_branching(spark, d):
    return M.branching(_words(spark, d, 5))


ROOTS = f"{AFFIX}, pre AS (SELECT affix AS prefix FROM a WHERE side = 'prefix' GROUP BY affix HAVING count(*) >= 20), m AS (SELECT word, freq, max_by(prefix, length(prefix)) AS prefix FROM k JOIN pre ON prefix = left(word, k) WHERE length(word) - k >= 2 GROUP BY word, freq), votes AS (SELECT substr(word, length(prefix) + 1) AS root, count(*) AS votes, sum(freq)::BIGINT AS freq FROM m GROUP BY 1)"


def _prefixes(words):
    return M.affix_counts(words).where("side = 'prefix' and types >= 20").select(F.col("affix").alias("prefix"))


def _roots(spark, d):
    w = _words(spark, d, 5)
    return w, M.root_votes(w, _prefixes(w))


@query(f"WITH {ROOTS} SELECT root, votes, freq FROM votes")
def root_votes(spark, d):
    return _roots(spark, d)[1]


@query(f"WITH {ROOTS}, big AS (SELECT * FROM votes WHERE votes >= 2) SELECT b.root, p.prefix, count(*) AS n FROM big b JOIN pre p ON starts_with(b.root, p.prefix) AND length(p.prefix) > 2 AND length(b.root) > length(p.prefix) + 1 JOIN votes s ON s.root = substr(b.root, length(p.prefix) + 1) GROUP BY ALL")
def root_contamination(spark, d):
    """Roots that begin with a known prefix and whose rest is a root too."""
    w, votes = _roots(spark, d)
    p = _prefixes(w).where("char_length(prefix) > 2")
    big = votes.where("votes >= 2").select("root", F.explode(F.sequence(F.lit(3), F.lit(5))).alias("k")).where("char_length(root) > k + 1")
    cut = big.select("root", F.expr("substring(root, 1, k)").alias("prefix"), F.expr("substring(root, k + 1)").alias("rest")).join(p, "prefix")
    return cut.join(votes.select(F.col("root").alias("rest")), "rest").groupBy("root", "prefix").agg(F.count("*").alias("n"))


@query(f"WITH {W}, x AS (SELECT word, freq, 'er' AS root FROM w WHERE word LIKE '%er%') SELECT left(word, length(word) - strpos(reverse(word), 're') - 1) AS prefix, sum(freq)::BIGINT AS freq FROM x GROUP BY 1 HAVING length(left(any_value(word), length(any_value(word)) - strpos(reverse(any_value(word)), 're') - 1)) BETWEEN 1 AND 3")
def prefix_discovery(spark, d):
    """What comes before the last occurrence of a root, up to three letters."""
    x = _words(spark, d).where("word like '%er%'").select(F.expr("left(word, char_length(word) - locate('re', reverse(word)) - 1)").alias("prefix"), "freq")
    return x.where("char_length(prefix) between 1 and 3").groupBy("prefix").agg(F.sum("freq").alias("freq"))


NASAL = values((c, len(c), f"{n}+{i}") for c, (n, initials) in R.NASALS.items() for i in initials)


@query(f"WITH {W}, r(c, k, f) AS (VALUES {NASAL}) SELECT word, f || substr(word, k + 1) AS form FROM w JOIN r ON starts_with(word, c)")
def nasal_underlying(spark, d):
    return _words(spark, d).select("word", F.explode(L.underlying(F.col("word"))).alias("form"))


@query(
    f"WITH {ROOTS}, top AS (SELECT root FROM votes WHERE votes >= 3 AND length(root) BETWEEN 2 AND 12), i AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM f), c AS (SELECT word, i, unnest(range(2, 13)) AS n FROM i), "
    "mm AS (SELECT word, i, n, substr(word, i, n) AS root, pow(n::DOUBLE, 2.5) * CASE WHEN i = 1 THEN 1.5 ELSE 1 END * CASE WHEN i + n - 1 = length(word) THEN 1.5 ELSE 1 END AS score FROM c WHERE i + n - 1 <= length(word) AND substr(word, i, n) IN (SELECT root FROM top)), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, n DESC, i) AS k FROM mm) "
    "SELECT f.word, coalesce(left(f.word, i - 1), '') AS prefix, coalesce(root, f.word) AS root, coalesce(substr(f.word, i + n), '') AS suffix, round(coalesce(score, 0), 6) AS score FROM f LEFT JOIN b ON f.word = b.word AND k = 1"
)
def decompose_best(spark, d):
    w, votes = _roots(spark, d)
    return M.decompose(w, votes.where("votes >= 3 and char_length(root) between 2 and 12")).withColumn("score", F.round("score", 6))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), 'n''t', ' not', 'g'), '''(s|re|ve|ll|d|m)', ' $1', 'g'), '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM documents".replace("$1", r"\1"))
def contraction_split(spark, d):
    x = F.regexp_replace(F.regexp_replace(F.lower("text"), "n't", " not"), "'(s|re|ve|ll|d|m)", " $1")
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).cast("long").alias("n_words"))


_RULES = values((k, p, c, pl, v, x) for k, (p, c, pl, v, x) in enumerate(R.PREFIXES))
MORPH_SQL = (
    f"WITH {W}, n(k, p, c, pl, v, x) AS (VALUES {_RULES}), s(k, p) AS (VALUES {values(enumerate(R.SUBJECTS))}), "
    "a AS (SELECT word, min(n.k) AS k FROM w JOIN n ON starts_with(word, p) AND length(word) > length(p) + 1 GROUP BY word), b AS (SELECT word, min(s.k) AS k FROM w JOIN s ON starts_with(word, p) AND length(word) > length(p) + 2 GROUP BY word), "
    "m AS (SELECT w.word, coalesce(n.p, s.p) AS prefix, substr(w.word, length(coalesce(n.p, s.p, '')) + 1) AS stem, CAST(coalesce(n.c, s.k + 1) AS INTEGER) AS noun_class, CASE WHEN n.v THEN 'verb' WHEN n.p IS NOT NULL THEN 'noun' WHEN s.p IS NOT NULL THEN 'verb' END AS pos, CASE WHEN n.p IS NOT NULL THEN n.x WHEN s.p IS NOT NULL THEN 0.55 ELSE 0.3 END::DOUBLE AS confidence "
    "FROM w LEFT JOIN a ON a.word = w.word LEFT JOIN n ON n.k = a.k LEFT JOIN b ON b.word = w.word LEFT JOIN s ON s.k = b.k)"
)


@query(MORPH_SQL + " SELECT * FROM m")
def stem_class(spark, d):
    m = L.morph(F.col("word"))
    return _words(spark, d).select("word", m.alias("m")).select("word", "m.prefix", "m.stem", "m.noun_class", "m.pos", "m.confidence")


@query(MORPH_SQL + " SELECT CASE WHEN confidence >= 0.7 THEN stem ELSE word END AS stem, count(*) AS words FROM m GROUP BY 1")
def canonical_stem(spark, d):
    return _words(spark, d).groupBy(L.stem(F.col("word")).alias("stem")).agg(F.count("*").alias("words"))


PHON = "replace(replace(regexp_replace(regexp_replace(regexp_replace(replace({x}, '-', ''), 'i([aeou])', '1\\1', 'g'), 'u([aeio1])', '2\\1', 'g'), 'o(a)', '2\\1', 'g'), '1', 'y'), '2', 'w')"
_ALPHA = "regexp_matches(word, '^[a-z]+$')"


@query(f"WITH {W} SELECT word, {PHON.format(x='word')} AS said FROM w WHERE {_ALPHA}")
def phon_normalise(spark, d):
    return _words(spark, d).where("word rlike '^[a-z]+$'").select("word", L.phonology(F.col("word")).alias("said"))


@query(f"WITH {W}, p AS (SELECT word, {PHON.format(x='word')} AS said FROM w WHERE {_ALPHA}) SELECT a.word AS a, b.word AS b FROM p a JOIN p b USING (said) WHERE a.word < b.word")
def phon_equiv_join(spark, d):
    """Pairs of words that sound alike: an equal key, not every pair of words."""
    p = _words(spark, d).where("word rlike '^[a-z]+$'").select("word", L.phonology(F.col("word")).alias("said"))
    return p.withColumnRenamed("word", "a").join(p.withColumnRenamed("word", "b"), "said").where("a < b").select("a", "b")


@query(MORPH_SQL + ", c AS (SELECT CASE WHEN confidence >= 0.7 THEN stem ELSE word END AS canonical, word FROM m) SELECT canonical, count(DISTINCT word) AS variants, min(word) AS first FROM c GROUP BY canonical HAVING count(DISTINCT word) > 1")
def variant_table(spark, d):
    x = _words(spark, d).select(L.stem(F.col("word")).alias("canonical"), "word")
    return x.groupBy("canonical").agg(F.count("*").alias("variants"), F.min("word").alias("first")).where("variants > 1")


@query(f"WITH {W}, x AS (SELECT '<' || word || '>' AS b FROM w WHERE freq >= 20), n AS (SELECT b, unnest(range(3, 7)) AS n FROM x), g AS (SELECT b, n, unnest(range(1, length(b) - n + 2)) AS i FROM n WHERE length(b) >= n) SELECT substr(b, i, n) AS gram, count(*) AS n FROM g GROUP BY 1")
def char_ngrams(spark, d):
    return _words(spark, d, 20).select(F.explode(S.char_grams(F.col("word"), 3, 6)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(length(t) - 2, 0) + 1), lambda i: substr(t, i, 3)))"


@query(f"WITH p AS (SELECT n_nationkey, n_name AS t FROM nation), g AS (SELECT n_nationkey AS k, {_GRAMS} AS s FROM p) SELECT a.k AS a, b.k AS b, CAST(len(list_intersect(a.s, b.s)) AS INTEGER) AS shared, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE, 6) AS jaccard FROM g a JOIN g b ON a.k < b.k WHERE len(list_intersect(a.s, b.s)) > 0")
def ngram_jaccard(spark, d):
    g = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.array_distinct(S.grams(F.col("n_name"), 3)).alias("s"))
    return S.overlaps(g, "k", "s").select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT a.vec_id AS query_id, b.vec_id, CAST(n AS INTEGER) AS rank, round(s, 5) AS score FROM (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE a.vec_id % 100 = 0) z JOIN embeddings a ON a.vec_id = x JOIN embeddings b ON b.vec_id = y WHERE n <= 5")
def cosine_topk(spark, d):
    """For the stated queries, their five nearest of the same label."""
    e = table(spark, d, "embeddings")
    return S.top_k(e.where("vec_id % 100 = 0"), e, 5).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


@query("SELECT a.vec_id AS query_id, b.vec_id, CAST(n AS INTEGER) AS rank, round(s, 5) AS score FROM (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) z JOIN embeddings a ON a.vec_id = x JOIN embeddings b ON b.vec_id = y WHERE n <= 5")
def cosine_topk_all(spark, d):
    """For the stated queries, their five nearest among all rows."""
    e = table(spark, d, "embeddings")
    return S.nearest_of_all(e.where("vec_id % 100 = 0"), e, 5).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


@query(f"WITH {W}, b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+')) AS word FROM benchmark) SELECT word FROM w INTERSECT SELECT word FROM b")
def ngram_intersect(spark, d):
    b = T.word_rows(table(spark, d, "benchmark"), "item_id").select("word")
    return _words(spark, d).select("word").intersect(b)


@query(f"WITH {W}, b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+')) AS word FROM benchmark) SELECT word FROM b EXCEPT SELECT word FROM w")
def ngram_except(spark, d):
    b = T.word_rows(table(spark, d, "benchmark"), "item_id").select("word")
    return b.subtract(_words(spark, d).select("word"))


ATTEST = r"att AS (SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS word FROM benchmark) GROUP BY word)"


def _attested(spark, d):
    return T.word_rows(table(spark, d, "benchmark"), "item_id").select("word").distinct()


@query(rf"WITH {ATTEST}, x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+')) AS word FROM documents) SELECT doc_id, count(*) AS n FROM x WHERE word IN (SELECT word FROM att) GROUP BY doc_id")
def attested_semi(spark, d):
    return T.word_rows(table(spark, d, "documents")).join(_attested(spark, d), "word", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"WITH {ATTEST}, x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+')) AS word FROM documents) SELECT doc_id, count(*) AS n FROM x WHERE word NOT IN (SELECT word FROM att) GROUP BY doc_id")
def unattested_anti(spark, d):
    return T.word_rows(table(spark, d, "documents")).join(_attested(spark, d), "word", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"WITH {ATTEST}, x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+')) AS word FROM documents) SELECT doc_id, round(avg((att.word IS NOT NULL)::INT), 6) AS ratio FROM x LEFT JOIN att USING (word) GROUP BY doc_id HAVING avg((att.word IS NOT NULL)::INT) >= 0.1")
def attest_ratio(spark, d):
    x = T.word_rows(table(spark, d, "documents")).select("doc_id", "word").distinct().join(_attested(spark, d).withColumn("ok", F.lit(1)), "word", "left")
    return x.groupBy("doc_id").agg(F.avg(F.coalesce("ok", F.lit(0)).cast("double")).alias("ratio")).where("ratio >= 0.1").withColumn("ratio", F.round("ratio", 6))


@query(r"WITH x AS (SELECT unnest(regexp_extract_all(text, '[^\s]+')) AS t FROM documents) SELECT t AS token, count(*) AS freq FROM x GROUP BY t HAVING count(*) >= 50")
def bpe_base_vocab(spark, d):
    x = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), 0)).alias("token"))
    return x.groupBy("token").agg(F.count("*").alias("freq")).where("freq >= 50")


@query(r"WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\s]+')) AS t, unnest(range(len(regexp_extract_all(text, '[^\s]+')))) AS i FROM documents), p AS (SELECT t AS l, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM x) SELECT l, r, count(*) AS freq FROM p WHERE r IS NOT NULL GROUP BY l, r ORDER BY freq DESC, l, r LIMIT 1")
def bpe_first_merge(spark, d):
    from ..operators.grammar import array_pair_counts

    x = table(spark, d, "documents").select(F.regexp_extract_all("text", F.lit(r"[^\s]+"), 0).alias("s"))
    return array_pair_counts(x, "s").orderBy(F.desc("freq"), "l", "r").limit(1)


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations")
def bpe_decode(spark, d):
    """Marked tokens back to text: the space marker becomes a space, separators go, white space is one space."""
    x = table(spark, d, "conversations").withColumn("m", F.regexp_replace("text", r"\s+", "<space>"))
    x = x.withColumn("t", F.transform(F.split("m", "<space>"), lambda w: F.concat(F.substring(w, 1, 2), F.lit("<morph_sep>"), F.substring(w, 3, 1 << 30))))
    joined = F.replace(F.array_join("t", "<space>"), F.lit("<morph_sep>"), F.lit(""))
    return x.select("conv_id", "turn", F.trim(F.regexp_replace(F.replace(joined, F.lit("<space>"), F.lit(" ")), r"\s+", " ")).alias("text"))


_ = Window, q
