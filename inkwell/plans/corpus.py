"""Queries over documents: passages, quality, vocabulary, sampling, duplicates and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import language, metadata
from inkwell.functions import text as T
from inkwell.operators import corpus
from inkwell.sources.tables import spread, table

#: The test documents have single line ends between paragraphs.
LINE = "\n"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return corpus.passages(_documents(spark, d), separator=LINE)


def passage_windows(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).select("doc_id", F.col("passage_no").cast("bigint"), F.col("n_words").cast("bigint"), F.md5(F.col("passage").cast("binary")).alias("passage_md5"))


def passage_dedupe_caps(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus.deduplicated_and_capped(_passages(spark, d), "passage", ["lang"], ["doc_id", "passage_no"], 300)
    return kept.select("lang", "doc_id", F.col("passage_no").cast("bigint"))


def passage_profile(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus.deduplicated_and_capped(_passages(spark, d), "passage", ["lang"], ["doc_id", "passage_no"], 300)
    return kept.groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_words"), 6).alias("mean_words"))


def exact_dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    last = corpus.last_values_first_place(table(spark, d, "documents").withColumn("place", F.col("doc_id")), "text", "place")
    return last.select("sha256", "first_place", "doc_id", "source")


def exact_dedupe_distinct(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.countDistinct(F.sha2("text", 256)).alias("texts"), F.count("*").alias("n"))


def site_caps(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus.capped_by_site(table(spark, d, "documents"), "source", "lang", ["doc_id"], cap=100)
    return kept.select("lang", "source", "doc_id")


def prose_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _documents(spark, d).select(
        "doc_id",
        T.word_count(t).cast("bigint").alias("n_words"),
        T.letters(t).cast("bigint").alias("n_letters"),
        T.capitals(t).cast("bigint").alias("n_capitals"),
        T.sentence_count(t).cast("bigint").alias("n_sentences"),
        F.size(T.sentences(t)).cast("bigint").alias("n_pieces"),
        T.has_strange_accents(t).alias("strange"),
    )


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    good = _documents(spark, d).join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return corpus.vocabulary(good, top=2000, least=3)


def vocabulary_topn(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d).select("word", "n")


def noise_report(spark: SparkSession, d: str) -> DataFrame:
    report = corpus.noise_report(_documents(spark, d), _vocabulary(spark, d), ["doc_id"], "text")
    six = [F.round(c, 6).alias(c) for c in ("common_ratio", "unknown_ratio", "fragment_ratio", "junk_per_100")]
    return report.select("doc_id", *six, "bad_case_words", "repeats")


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    passages = _passages(spark, d)
    report = corpus.noise_report(passages, _vocabulary(spark, d), ["doc_id", "passage_no"], "passage").withColumn("clean", corpus.is_clean())
    judged = passages.join(report.select("doc_id", "passage_no", "clean"), ["doc_id", "passage_no"])
    reason = corpus.reject_reason(F.col("passage"), F.col("clean"))
    return judged.groupBy("lang", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def language_guess(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", language.guess(F.col("text")).alias("guess"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return corpus.spread(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 7, "seed").select("source", "doc_id")


def edge_trim(spark: SparkSession, d: str) -> DataFrame:
    return corpus.edge_trimmed(_documents(spark, d), "doc_id").select("doc_id", F.col("block_no").cast("bigint"), F.length("block").cast("bigint").alias("n_chars"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.signature(F.col("text")).alias("signature"))


def folded_words(spark: SparkSession, d: str) -> DataFrame:
    words = _documents(spark, d).select(F.explode(T.words(F.col("text"))).alias("w"))
    return words.groupBy(T.fold(F.col("w")).alias("word")).agg(F.count("*").alias("n"))


def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.rollup("lang", "quality").agg(F.count("*").alias("n"), F.min("n_chars").alias("least_chars"), F.max("n_chars").alias("most_chars"))


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue fields of each order, chosen by its key, so that every rule meets every other one's outcome."""
    pick = lambda values, step: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.floor(F.col("o_orderkey") / step), F.lit(len(values))) + 1).cast("int"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        pick(("English-PD", "French-PD-Books", "US-PD-Newspapers", "Gutenberg"), 1).alias("collection"),
        pick(("Open Culture", "Open Culture", "Open Web"), 4).alias("open_type"),
        pick(("Public Domain", "Publc Domain", "CC-By"), 2).alias("license"),
        F.when(F.col("o_orderkey") % 11 != 0, F.lit(1800.0) + F.col("o_custkey") % 200).alias("date"),
        F.when(F.col("o_orderkey") % 5 == 0, "None").when(F.col("o_orderkey") % 5 != 1, F.concat(F.lit(" Title "), "o_custkey")).alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Client, "), "o_orderpriority", F.lit(", 1820-1900|x"))).alias("creator"),
        pick(("English", "French", "German"), 3).alias("language"),
        (F.col("o_custkey") % 1000).cast("int").alias("word_count"),
    )


def select_documents(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    kept = _metadata(spark, d).where(metadata.selected(c("open_type"), c("language"), c("license"), c("collection"), c("date"), c("word_count")))
    credit = metadata.credit_for(c("title"), c("creator"), c("collection"), c("date"))
    return kept.select("o_orderkey", metadata.lookup(c("language"), metadata.LANGUAGES).alias("lang"), metadata.lookup(c("collection"), metadata.KIND_BY_COLLECTION).alias("kind"), credit["credit"].alias("credit"), credit["title"].alias("shown_title"))


def catalog_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Authors and titles as a catalogue writes them, of each customer."""
    key, death = F.col("c_custkey"), F.col("c_custkey") % 150 + 1850
    author = F.when(key % 4 == 0, F.concat(F.lit("Name"), key, F.lit(", Ann B. (Anna Bo), 1801-"), death)).when(key % 4 == 1, F.concat(F.lit("Mono"), key)).when(key % 4 == 2, F.concat(F.lit("Last, First"), key, F.lit(", 1801-"), death, F.lit("; Other, Who [Illustrator]"))).otherwise("Anonymous")
    title = F.when(key % 3 == 0, F.concat(F.lit("Title "), key, F.lit(": a sequel"))).when(key % 3 == 1, F.concat(F.lit("Essais "), key, F.lit(" — Volume 1"))).otherwise(F.concat(F.lit("First\nSecond "), key))
    parsed = metadata.parse_author(author)
    return table(spark, d, "customer").select("c_custkey", parsed["name"].alias("name"), parsed["death"].alias("death"), metadata.short_title(title).alias("short"), metadata.public_domain(parsed["death"]).alias("free"))


def repaired_texts(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document misread in four ways, and with an editor's marks."""
    word, k = F.regexp_extract("text", "[a-zA-Z]+", 0), F.pmod("doc_id", F.lit(4))
    broken = F.when(k == 0, F.concat(word, F.lit(" mÃ©tiers"))).when(k == 1, F.concat(word, F.lit(" métiers Ã"))).when(k == 2, F.concat(word, F.lit(" \x97 unless"))).otherwise(F.concat(F.lit("[Illustration: a cat] _"), word, F.lit("_ [Pg 12]day.")))
    return table(spark, d, "documents").select("doc_id", metadata.fix_mojibake(broken).alias("fixed"), T.clean_book(broken).alias("cleaned"))


def dehyphenated(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's text with broken words, of which the vocabulary knows some."""
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("the gar- den of "), "c_mktsegment", F.lit(", a well- known tra- versing of gar- den- paths")).alias("t"))
    vocab = spark.createDataFrame([("garden",), ("traversing",)], "word string")
    return corpus.dehyphenated(rows, vocab, ["c_custkey"], "t")


def article_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents read as articles, with lines of a page put around them."""
    page = F.concat(F.lit("Sign up for our newsletter\r\nA line of the page\n"), "text", F.when(F.col("doc_id") % 2 == 0, "\nRead more\nAnother title").otherwise("\n\n  Cookies \nlast line"))
    body = T.clean_article(page)
    return table(spark, d, "documents").select("doc_id", F.md5(body.cast("binary")).alias("body_md5"), F.length(body).cast("bigint").alias("n"))


def crawl_years(spark: SparkSession, d: str) -> DataFrame:
    """A crawl's name for each page, some unknown or missing."""
    k = F.pmod("page_id", F.lit(10))
    dump = F.when(k == 8, "unknown").when(k < 8, F.concat(F.lit("CC-MAIN-"), k + 2017, F.lit("-21")))
    year = metadata.crawl_year(dump)
    return table(spark, d, "pages").select("page_id", year.alias("year"), F.coalesce(year <= metadata.LATEST_CRAWL_YEAR, F.lit(False)).alias("usable"))


QUERIES = {f.__name__: f for f in (
    passage_windows, passage_dedupe_caps, passage_profile, exact_dedupe_last_wins, exact_dedupe_distinct, site_caps, prose_metrics, vocabulary_topn, noise_report,
    reject_reasons, language_guess, stratified_sample, edge_trim, signatures, folded_words, corpus_profile, select_documents, catalog_metadata, repaired_texts, dehyphenated, article_lines, crawl_years,
)}

# DuckDB. RE2 has no look-around: a sentence break is marked by a replacement that keeps both neighbours.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class _Sql(str):
    """SQL with @ where an expression goes; its braces belong to regular expressions."""

    def format(self, value: str) -> str:
        return self.replace("@", value)


_TOKENS = _Sql("list_filter(regexp_split_to_array(@, '" + _WS + "+'), lambda w: w <> '')")
_MARK = _Sql(r"""string_split(regexp_replace(@, '([.!?…»"”’])""" + _WS + r"""+(["“«‘''—\-]?[A-ZÀ-Ý])', '\1' || chr(1) || '\2', 'g'), chr(1))""")
_WORDS = _Sql(r"regexp_extract_all(@, '\p{L}+(?:[''’-]\p{L}+)*')")
_FOLD = _Sql(r"regexp_replace(strip_accents(lower(@)), '\p{Mn}+', '', 'g')")


def _windows(most: int = T.MAX_WORDS, least: int = T.MIN_WORDS) -> str:
    """Passages by a fold over sentences: (doc_id, lang, source, passage_no, passage, n_words)."""
    count = lambda x: f"len({_TOKENS.format(x)})"
    return f"""
  SELECT doc_id, lang, source, (row_number() OVER (PARTITION BY doc_id ORDER BY block_no, piece_no) - 1)::bigint AS passage_no, passage, n_words FROM (
    SELECT doc_id, lang, source, block_no, unnest(pieces) AS passage, generate_subscripts(pieces, 1) AS piece_no, {count('passage')} AS n_words FROM (
      SELECT *, CASE WHEN {count('block')} <= {most} THEN [block] ELSE
        (list_reduce(list_transform({_MARK.format('block')}, lambda s: {{'p': [s], 'n': {count('s')}}}),
          lambda a, b: CASE WHEN a.n + b.n > {most} THEN {{'p': a.p || b.p, 'n': b.n}} ELSE {{'p': list_slice(a.p, 1, len(a.p) - 1) || [a.p[len(a.p)] || ' ' || b.p[1]], 'n': a.n + b.n}} END)).p END AS pieces
      FROM (SELECT doc_id, lang, source, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS block_no FROM (
        SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: array_to_string({_TOKENS.format('x')}, ' ')), lambda x: x <> '') AS blocks FROM documents)))
    ) WHERE n_words BETWEEN {least} AND {most}"""


_WINDOWS = _windows()
_SIGNATURE = _Sql(r"substr(regexp_replace(lower(@), '[^\p{L}\p{N}]+', '', 'g'), 1, 160)")
_KEPT = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, passage_no) AS k FROM (
  SELECT * FROM ({_WINDOWS}) QUALIFY row_number() OVER (PARTITION BY {_SIGNATURE.format('passage')} ORDER BY doc_id, passage_no) = 1)) WHERE k <= 300"""
_VOCAB = f"""SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT {_FOLD.format('w')} AS word FROM (
  SELECT unnest({_WORDS.format('text')}) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))) GROUP BY word ORDER BY n DESC, word LIMIT 2000) WHERE n >= 3 AND length(word) > 1"""
_SENTENCES = _Sql("len(list_filter(regexp_split_to_array(regexp_replace(@, '^" + _WS + "+|" + _WS + "+$', '', 'g'), '[.!?…]+[\"”»’)]*" + _WS + "+'), lambda s: regexp_matches(s, '[^" + _WS[1:] + "')))")

#: A line of a page: RE2 has no look-around, so the neighbours of a word are part of the match.
_PAGE = "(?i)(?:^|[^\\p{L}\\p{N}_])" + T.PAGE_LINE[T.PAGE_LINE.index("(subscribe") : T.PAGE_LINE.rindex("(?![")].replace("'", "''") + "(?:$|[^\\p{L}\\p{N}_])"

#: Runs of a character four times or more: RE2 has no back-references.
_REPEATS = "len(list_filter(range(1, len(c) - 2), lambda i: c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3] AND c[i] <> chr(10) AND (i = 1 OR c[i - 1] <> c[i])))"
_EN = ", ".join(f"'{w}'" for w in language.ENGLISH)
_FR = ", ".join(f"'{w}'" for w in language.FRENCH)

ORACLES = {
    "passage_windows": f"SELECT doc_id, passage_no, n_words::bigint AS n_words, md5(passage) AS passage_md5 FROM ({_WINDOWS})",
    "passage_dedupe_caps": f"SELECT lang, doc_id, passage_no FROM ({_KEPT})",
    "passage_profile": f"SELECT lang, source, count(*) AS n, round(avg(n_words), 6) AS mean_words FROM ({_KEPT}) GROUP BY lang, source",
    "exact_dedupe_last_wins": "SELECT sha256(text) AS sha256, min(doc_id) AS first_place, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY 1",
    "exact_dedupe_distinct": "SELECT lang, count(DISTINCT sha256(text)) AS texts, count(*) AS n FROM documents GROUP BY lang",
    "site_caps": "SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 12)) WHERE k <= 100",
    "prose_metrics": rf"SELECT doc_id, len({_TOKENS.format('text')})::bigint AS n_words, len(regexp_extract_all(text, '\p{{L}}'))::bigint AS n_letters, len(regexp_extract_all(text, '\p{{Lu}}'))::bigint AS n_capitals, {_SENTENCES.format('text')}::bigint AS n_sentences, len({_MARK.format('text')})::bigint AS n_pieces, len(regexp_extract_all(text, '{T.STRANGE_ACCENT}')) >= 2 AS strange FROM documents",
    "vocabulary_topn": _VOCAB,
    "noise_report": rf"""
WITH v AS ({_VOCAB}), w AS (SELECT doc_id, {_FOLD.format('w')} AS word FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents)),
s AS (SELECT doc_id, count(*) AS n, count(v.word) AS known, count(*) FILTER (v.word IS NULL AND length(w.word) >= 4) AS unknown, count(*) FILTER (v.word IS NULL AND length(w.word) <= 2) AS fragment FROM w LEFT JOIN v USING (word) GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(known / greatest(n, 1), 0), 6) AS common_ratio, round(coalesce(unknown / greatest(n, 1), 0), 6) AS unknown_ratio, round(coalesce(fragment / greatest(n, 1), 0), 6) AS fragment_ratio,
  round(100 * len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}_\s\x0b\x{{a0}}.,;:!?''’"“”«»()\-—–…%$&/]'))::double / greatest(length(text), 1), 6) AS junk_per_100,
  len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '[a-zà-ÿ][A-ZÀ-Ý]')))::bigint AS bad_case_words, {_REPEATS}::bigint AS repeats
FROM (SELECT *, string_split(text, '') AS c FROM documents) d LEFT JOIN s USING (doc_id)""",
    "reject_reasons": rf"""
WITH p AS ({_WINDOWS}), v AS ({_VOCAB}),
w AS (SELECT doc_id, passage_no, {_FOLD.format('w')} AS word FROM (SELECT doc_id, passage_no, unnest({_WORDS.format('passage')}) AS w FROM p)),
s AS (SELECT doc_id, passage_no, count(*) AS n, count(v.word) AS known, count(*) FILTER (v.word IS NULL AND length(w.word) >= 4) AS unknown, count(*) FILTER (v.word IS NULL AND length(w.word) <= 2) AS fragment FROM w LEFT JOIN v USING (word) GROUP BY ALL),
m AS (SELECT p.*, string_split(passage, '') AS c, len(regexp_extract_all(passage, '\p{{L}}')) AS letters, len(regexp_extract_all(passage, '\p{{Lu}}')) AS capitals, len({_WORDS.format('passage')}) AS n_wordlike, {_SENTENCES.format('passage')} AS parts,
  coalesce(known / greatest(n, 1), 0) AS common_ratio, coalesce(unknown / greatest(n, 1), 0) AS unknown_ratio, coalesce(fragment / greatest(n, 1), 0) AS fragment_ratio FROM p LEFT JOIN s USING (doc_id, passage_no)),
r AS (SELECT lang, CASE
  WHEN regexp_matches(passage, 'https?://|www\.|@[\p{{L}}\p{{N}}_]+\.') OR regexp_matches(passage, '[_\[\]{{}}*^]|(?:^|[^\p{{L}}\p{{N}}_])[A-ZÀ-Ý]{{4,}}(?:$|[^\p{{L}}\p{{N}}_])')
    OR regexp_matches(passage, '(?i)^(chapter|book|part|volume|livre|chapitre|partie|tome|section)(?:$|[^\p{{L}}\p{{N}}_])') OR letters::double / greatest(length(passage), 1) < 0.78 OR capitals::double / greatest(letters, 1) > 0.12
    OR NOT regexp_matches(passage, '[.!?…"”»’]$') OR len(regexp_extract_all(passage, '["“«—]'))::double / greatest(n_words, 1) >= 0.06 THEN 'not prose'
  WHEN parts < 2 OR n_wordlike < parts * 6 OR n_wordlike > parts * 45 OR len(regexp_extract_all(passage, '\p{{Nd}}'))::double / greatest(length(passage), 1) > 0.02
    OR len(list_filter(list_slice({_TOKENS.format('passage')}, 2, n_words), lambda t: regexp_matches(t, '^\p{{Lu}}')))::double / greatest(n_words - 1, 1) > 0.30 THEN 'list or table'
  WHEN len(regexp_extract_all(passage, '{T.STRANGE_ACCENT}')) >= 2 THEN 'misread letters'
  WHEN common_ratio < 0.35 OR unknown_ratio > 0.10 OR fragment_ratio > 0.22 OR 100 * len(regexp_extract_all(passage, '[^\p{{L}}\p{{N}}_\s\x0b\x{{a0}}.,;:!?''’"“”«»()\-—–…%$&/]'))::double / greatest(length(passage), 1) > 1.5
    OR len(list_filter(regexp_extract_all(passage, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '[a-zà-ÿ][A-ZÀ-Ý]'))) > 0 OR {_REPEATS} > 0 THEN 'ocr noise'
  ELSE 'kept' END AS reason FROM m)
SELECT lang, reason, count(*) AS n FROM r GROUP BY ALL""",
    "language_guess": rf"""
SELECT doc_id, CASE WHEN n < 8 OR en + fr < 3 THEN NULL WHEN fr > en * 1.3 THEN 'fr' WHEN en > fr * 1.3 THEN 'en' END AS guess FROM (
  SELECT doc_id, len(w) AS n, len(list_filter(p, lambda x: list_contains([{_EN}], x))) AS en,
    len(w) - len(p) + len(list_filter(p, lambda x: list_contains([{_FR}], x))) AS fr FROM (
    SELECT doc_id, w, list_transform(list_filter(w, lambda x: NOT regexp_matches(x, '^(?:[lLdDnNcCjJsSmMtT]|[qQ][uU])''\p{{Ll}}')), lambda x: string_split(lower(x), '''')[1]) AS p FROM (
      SELECT doc_id, regexp_extract_all(replace(text, '’', ''''), '[\p{{L}}'']+') AS w FROM documents)))""",
    "stratified_sample": """
WITH r AS (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS at FROM documents),
e AS (SELECT source, n, i, round_even(i * n::double / 7, 0)::bigint AS a, round_even((i + 1) * n::double / 7, 0)::bigint AS b FROM (SELECT DISTINCT source, n FROM r), range(7) t(i))
SELECT source, doc_id FROM r WHERE n <= 7 UNION ALL
SELECT r.source, r.doc_id FROM r JOIN e ON r.source = e.source AND r.n > 7 AND r.at = e.a + ('0x' || substr(md5('seed-' || e.source || '-' || e.i), 1, 8))::bigint % greatest(e.b - e.a, 1)""",
    "edge_trim": f"""
SELECT doc_id, (generate_subscripts(kept, 1) - 1)::bigint AS block_no, length(unnest(kept))::bigint AS n_chars FROM (
  SELECT doc_id, list_slice(b, greatest(len(b) // 20, 1) + 1, len(b) - greatest(len(b) // 20, 1)) AS kept FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: array_to_string({_TOKENS.format('x')}, ' ')), lambda x: x <> '') AS b FROM documents))""",
    "signatures": f"SELECT doc_id, {_SIGNATURE.format('text')} AS signature FROM documents",
    "folded_words": f"SELECT {_FOLD.format('w')} AS word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS w FROM documents) GROUP BY 1",
    "corpus_profile": "SELECT lang, quality, count(*) AS n, min(n_chars) AS least_chars, max(n_chars) AS most_chars FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, quality)",
    "select_documents": """
WITH m AS (SELECT o_orderkey, (['English-PD', 'French-PD-Books', 'US-PD-Newspapers', 'Gutenberg'])[(o_orderkey % 4 + 1)::int] AS collection, (['Open Culture', 'Open Culture', 'Open Web'])[(o_orderkey // 4 % 3 + 1)::int] AS open_type,
  (['Public Domain', 'Publc Domain', 'CC-By'])[(o_orderkey // 2 % 3 + 1)::int] AS license, CASE WHEN o_orderkey % 11 <> 0 THEN 1800 + o_custkey % 200 END AS year,
  CASE WHEN o_orderkey % 5 > 1 THEN 'Title ' || o_custkey ELSE '' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ' Client' ELSE '' END AS author,
  (['English', 'French', 'German'])[(o_orderkey // 3 % 3 + 1)::int] AS language, o_custkey % 1000 AS words FROM orders)
SELECT o_orderkey, CASE language WHEN 'English' THEN 'en' ELSE 'fr' END AS lang, CASE WHEN collection LIKE '%Newspapers' THEN 'news' ELSE 'book' END AS kind,
  CASE WHEN author <> '' THEN author WHEN title <> '' THEN title ELSE CASE WHEN collection LIKE '%Newspapers' THEN 'US newspaper' ELSE 'Book' END || ' (' || year || ')' END AS credit,
  CASE WHEN title <> '' THEN title WHEN author <> '' THEN author ELSE CASE WHEN collection LIKE '%Newspapers' THEN 'US newspaper' ELSE 'Book' END || ', ' || year END AS shown_title
FROM m WHERE open_type = 'Open Culture' AND language <> 'German' AND license <> 'CC-By' AND collection <> 'Gutenberg' AND year <= 1950 AND words >= 500""",
    "catalog_metadata": """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Ann B. Name' || c_custkey WHEN 1 THEN 'Mono' || c_custkey WHEN 2 THEN 'First' || c_custkey || ' Last' ELSE 'Anonymous' END AS name,
  CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 150 + 1850)::int END AS death, CASE c_custkey % 3 WHEN 0 THEN 'Title ' || c_custkey WHEN 1 THEN 'Essais ' || c_custkey ELSE 'First' END AS short,
  c_custkey % 2 = 0 AND c_custkey % 150 + 1850 <= 1955 AS free FROM customer""",
    "repaired_texts": """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN w || ' métiers' WHEN 1 THEN w || ' métiers Ã' WHEN 2 THEN w || ' — unless' ELSE '[Illustration: a cat] _' || w || '_ [Pg 12]day.' END AS fixed,
  CASE doc_id % 4 WHEN 0 THEN w || ' mÃ©tiers' WHEN 1 THEN w || ' métiers Ã' WHEN 2 THEN w || ' ' || chr(151) || ' unless' ELSE '  ' || CASE WHEN w = '' THEN '__' ELSE w END || ' day.' END AS cleaned
FROM (SELECT doc_id, regexp_extract(text, '[a-zA-Z]+') AS w FROM documents)""",
    "dehyphenated": "SELECT c_custkey, 'the garden of ' || c_mktsegment || ', a well-known traversing of garden- paths' AS t FROM customer",
    "article_lines": rf"""
WITH p AS (SELECT doc_id, 'Sign up for our newsletter' || chr(10) || 'A line of the page' || chr(10) || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Read more' || chr(10) || 'Another title' ELSE chr(10) || chr(10) || '  Cookies ' || chr(10) || 'last line' END AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(t, chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS lines FROM p),
f AS (SELECT doc_id, lines, coalesce(list_position(list_transform(lines, lambda x: regexp_matches(x, '(?i)^(related|read more|more from|you may also|lire aussi|à lire aussi)')), true), len(lines) + 1) AS foot FROM l),
b AS (SELECT doc_id, array_to_string(list_filter(list_slice(lines, 1, foot - 1), lambda x: len({_TOKENS.format('x')}) >= {T.PAGE_LINE_WORDS} OR NOT regexp_matches(x, '{_PAGE}')), chr(10) || chr(10)) AS body FROM f)
SELECT doc_id, md5(body) AS body_md5, length(body)::bigint AS n FROM b""",
    "crawl_years": "SELECT page_id, CASE WHEN page_id % 10 < 8 THEN (page_id % 10 + 2017)::int END AS year, page_id % 10 <= 5 AS usable FROM pages",
}
